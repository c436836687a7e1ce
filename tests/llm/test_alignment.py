import hashlib
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import alignment
from riskweave.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = ["Hello world, don't stop!", "Hello world, don't stop!", None, "", " ", "  two  spaces  ", "a\n\n b\t\tc \n", "naïve café Straße ½ x² 10 000", "漢字 and 🙂 emoji", "with ▁ mark", "<|endoftext|> <s> </s> <0x41> [INST]", "\x1c\x85\xa0 odd white\x0bspace", "нет слов", "x" * 300 + " " * 40 + "y", "\x00 zero", "they'll we've I'm 'tis", "J̌ ṯ marks"]


def naive():
    """Each text encoded whole, every pair of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    out = []
    for text in TEXTS:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
            out.append(([], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, own_spans = 0, []
            for x in parts:
                own_spans.append((at, at + len(x)))
                at += len(x)
            spans.append(own_spans)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for c in cuts:
            inside = [[str(i) for i, (s, e) in zip(ids, own_spans, strict=True) if before <= s and e <= c] for ids, own_spans in zip((ids_a, ids_b), spans, strict=True)]
            groups.append("|".join(",".join(x) for x in inside))
            before = c
        out.append((ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if i == 8 else i, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a long, pairs string")


@pytest.mark.parametrize("block", [alignment.BLOCK, 30])
def test_alignment(docs, block):
    right = naive()
    counts = Counter(p for *_, links in right for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    wanted = []
    for i, (a, b, groups, links) in enumerate(right):
        wanted.append((str(None if i == 8 else i), len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    got = alignment.alignment(docs, A, B, block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(wanted)
    assert sum(bool(w[1]) for w in wanted) >= 12


def test_links_of_documents(docs):
    got = {}
    for r in alignment.alignments(docs.repartition(2), A, B).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (a, b, _, links) in enumerate(naive()):
        if i != 8:
            rows = sorted(got.get(i, []), key=lambda r: r.start)
            assert [(r.a, r.b) for r in rows] == links
            assert all(a[r.place_a] == r.a and b[r.place_b] == r.b and r.start < r.stop for r in rows)


def encoded(tok, text):
    return np.frombuffer(b"".join(tok.parts.of(tok.cut(text))), "<i4").tolist()


def test_parts_encode_like_whole_texts(spark):
    """Texts of the test tables, and each text of this file, by parts and whole."""
    import os

    folder = "/root/testdata/sf0.001"
    texts = [t for t in TEXTS if t]
    if os.path.isdir(folder):
        texts += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("text <> ''").collect()]
    for tok, whole in zip(alignment.tokenizers(A, B), (lambda t, x: t.tokenizer.encode(x, add_special_tokens=False).ids, lambda t, x: t.model.encode(x[1:])), strict=True):
        for text in texts:
            if "▁" not in text:
                assert encoded(tok, " " + text) == whole(tok, " " + text)


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 5)
    tok = alignment.TokenizerB(B)
    for text in (" a b c d", " e f g h i j k l", " a z"):
        assert encoded(tok, text) == tok.model.encode(text[1:])
        assert len(tok.parts.known) <= 10


def test_empty_table(docs):
    assert alignment.alignment(docs.limit(0), A, B).count() == 0


def test_long_texts(spark):
    text = "some words that go on, " * 60_000
    got = alignment.alignment(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), A, B).collect()
    assert {r.doc_id for r in got} == {1, 2} and max(r.n_a for r in got) > 300_000

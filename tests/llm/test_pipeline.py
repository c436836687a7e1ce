"""Each stage of the corpus pipeline, and the whole, against brute-force versions."""

import itertools
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_operators import shingles, windows

from riskweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n double"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, two texts under one id, rows without id, benchmark passages, blank and repeating texts; columns with clashing names."""
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "der", "lin", "mo", "ras", "tu"]) for _ in range(4)) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    swapped = lambda t, *at: " ".join("changed" if i in at else w for i, w in enumerate(t.split()))
    t, u, v, item = text(80), text(80), text(70), text(30)
    texts = [(5, t), (5, u), (6, swapped(t, 3)), (7, swapped(u, 9)), (8, v), (9, v), (8, v), (None, swapped(v, 4)), (None, text(60)), (10, None), (11, ""), (12, " \n "), (13, "same " * 300), (14, "short"), (17, " ".join("##%" + w + "&&!!" for w in text(60).split())), (15, text(20) + " " + item), (16, text(900) + " " + " ".join(item.split()[:20])), (None, item + " " + text(15))]
    texts += [(20 + i, text(rng.randrange(30, 200))) for i in range(40)]
    rows = [(i, x, rng.choice(["en", "de", None]), rng.choice("ab"), len(x or ""), "k", 0.5) for i, x in texts]
    return spark.createDataFrame(rows, SCHEMA), item


def keyed(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def base_failed(text):
    words = (text or "").split()
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(5)}
    return len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_quality_rules(spark, docs):
    got = corpus_pipeline.quality_rules(spark, docs[0], "")
    assert got.columns == corpus_pipeline.COLUMNS
    # every text here is fine, full of symbols (17), or fails the base rule
    assert keyed(got) == Counter({k: n for k, n in keyed(docs[0]).items() if k[0] != 17 and not base_failed(k[1])})


def test_near_duplicates(spark, docs):
    rows = list(keyed(docs[0]).items())
    sets = [shingles(x) for (_, x), _ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            group[find(i)] = find(j)
    got = keyed(corpus_pipeline.near_duplicates(spark, docs[0], ""))
    for i, (row, n) in enumerate(rows):
        if not sets[i]:
            assert got[row] == n
    kept = Counter(find(i) for i, (row, _) in enumerate(rows) if sets[i] and got[row])
    assert set(kept) == {find(i) for i in range(len(rows)) if sets[i]} and set(kept.values()) == {1}
    for root in kept:  # the least id of the group stays, once
        ids = [row[0] for i, (row, _) in enumerate(rows) if find(i) == root and row[0] is not None]
        stays = next(row for i, (row, _) in enumerate(rows) if find(i) == root and got[row])
        assert stays[0] == min(ids, default=None) and got[stays] == 1


def test_decontamination(spark, docs, tmp_path):
    spark.createDataFrame([(1, docs[1]), (2, None), (1, docs[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wanted = set(windows(docs[1])[1])
    clean = Counter()
    for row, n in keyed(docs[0]).items():
        words, parts = windows(row[1])
        hit = {i + k for i, g in enumerate(parts) if g in wanted for k in range(len(g))}
        if not (hit and 20 * len(hit) >= len(words)):
            clean[row] = n
    got = corpus_pipeline.decontamination(spark, docs[0], str(tmp_path))
    assert keyed(got) == clean and (16, docs[0].where("doc_id = 16").head().text) in clean
    assert 15 not in {i for i, _ in clean} and got.columns == corpus_pipeline.COLUMNS


def test_token_output(spark, docs):
    from tokenizers import Tokenizer

    tk, start, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0, []
    rows = [k for k, n in keyed(docs[0]).items() for _ in range(n)]
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tk.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.token_output(spark, docs[0], "").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


@pytest.mark.parametrize("name", ["all", "none"])
def test_run(spark, docs, tmp_path, name):
    rows = docs[0].limit(0) if name == "none" else docs[0]
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, docs[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) > 0) == (name == "all") and all(r.doc_id not in (10, 11, 12, 13, 14, 15) for r in got)

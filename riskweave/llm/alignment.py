"""Alignment of two tokenizers over the same bytes.

Both encode a space and the text. All documents of an Arrow batch lie one after the other in one range
of bytes; one bincount of the places at which tokens of A end and one of those of B mark the range.
Where both end is a cut between groups, and where either ends is the end of a link, for two tokens
overlap in one stretch of bytes only. Prefix sums over the range, read at the documents' borders, give
each document's counts, and read at a token's end its group. Nothing loops over documents or groups but
the hashing of their strings.

Texts are encoded by parts whose ids do not depend on what stands beside them, and each part once: for A
the words of its splitting rule (only in texts of letters below U+0280, about which all versions of
Unicode agree; others are encoded whole), for B a run of spaces and what follows, as no piece holds a
space after anything else (checked when the model is read).

A pair's count, the number of documents that hold it linked, comes from one aggregation of what tasks
have counted before. The counts are then looked up in blocks of bounded size, ranges of A's ids, one
after the other; there are no more blocks than the two vocabularies' product allows, whatever the input.

Cases: texts that are null, empty, or that one tokenizer does not give back byte by byte (those with
U+2581) have no tokens: zeros and an empty hash. Rows stay rows: repeated ones give equal results and
count as documents of their own, null ids stay. Very long texts are encoded whole. An empty table gives
an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, stored, text_bytes

#: Parts that a worker process remembers for each tokenizer, twice, and the longest of them.
KEPT, KEPT_LENGTH = 400_000, 64
#: Distinct pairs that a task counts before it hands them on; pairs of a block of counts.
COUNTED = BLOCK = 4_000_000
SPACE_MARK = "▁"
#: Fixed: characters that A's splitting rule takes as white space, of those below U+0280.
WHITE = "\\t-\\r \\x85\\xa0"
LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x280) if unicodedata.category(chr(i))[0] == kind)


def splitter() -> re.Pattern:
    """Words of the byte-level tokenizer: endings after an apostrophe; letters, digits or other signs with one space before them; white space, whose last character stays with a word that follows."""
    letters, digits = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{WHITE}{letters}{digits}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Parts:
    """Token ids of parts of texts; a part is encoded once, and kept for as long as it is in use: what no text has held since the memory was last full goes when it is full again."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: list[bytes]):
        self.encode, self.bytes_of = encode, bytes_of
        self.size = np.array([len(x) for x in bytes_of], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Parts that do not come back byte by byte.
        self.broken: set[str] = set()

    def _learned(self, fresh: set[str]) -> list[str]:
        """Sees to it that these parts are known; returns those that are too long to stay."""
        known, older = self.known, self.older
        known.update([(x, older[x]) for x in fresh if x in older])
        new = [x for x in fresh if x not in known]
        for x, ids in zip(new, self.encode(new), strict=True):
            known[x] = array("i", ids).tobytes()
            if b"".join([self.bytes_of[i] for i in ids]) != x.encode():
                self.broken.add(x)
        return [x for x in new if len(x) > KEPT_LENGTH]

    def of(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as 32-bit integers."""
        distinct = set(parts)
        fresh = distinct.difference(self.known)
        if len(self.known) + len(fresh) > KEPT:
            self.older, self.known, self.broken, fresh = self.known, {}, set(), distinct
            self.broken.update(x for x in distinct if x in self.older and b"".join([self.bytes_of[i] for i in array("i", self.older[x])]) != x.encode())
        long = self._learned(fresh) if fresh else []
        out = list(map(self.known.__getitem__, parts))
        for x in long:
            del self.known[x]
        return out


class TokenizerA:
    """A byte-level tokenizer from its file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        value, special = byte_values(), {i: x.content.encode() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        names = {i: x for x, i in self.tokenizer.get_vocab().items()}
        self.bytes_of = [special[i] if i in special else bytes(value[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.parts, self.split, self.rare = Parts(self._encoded, self.bytes_of), splitter(), re.compile("[^\x00-ɿ]")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str) -> list[str]:
        return [text] if self.rare.search(text) else self.split.findall(text)


class TokenizerB:
    """A piece tokenizer from its file; it sets a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, pieces = self.model, list(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        self.by_spaces = not any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in pieces)
        self.bytes_of = [b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(x[3:5], 16)]) if m.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(pieces)]
        self.space = m.piece_to_id(SPACE_MARK)
        self.parts, self.split = Parts(self._encoded, self.bytes_of), re.compile(" +[^ ]*")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """texts: each begins with the space that the model sets."""
        return [ids if x != " " else [self.space] for x, ids in zip(texts, self.model.encode([x[1:] for x in texts], num_threads=1), strict=True)]

    def cut(self, text: str) -> list[str]:
        return self.split.findall(text) if self.by_spaces else [text]


@lru_cache(2)
def tokenizers(a: str, b: str) -> tuple[TokenizerA, TokenizerB]:
    """One memory of parts for all tasks that a worker process runs."""
    return TokenizerA(a), TokenizerB(b)


def _encoded(tok: TokenizerA | TokenizerB, texts: list[str]) -> tuple[np.ndarray, Callable[[], np.ndarray], np.ndarray]:
    """Ids of all texts, a function that tells how many each has, and which texts come back byte by byte."""
    cut = list(map(tok.cut, texts))
    ids = tok.parts.of(list(chain.from_iterable(cut)))
    good = np.ones(len(texts), bool)
    if broken := tok.parts.broken:
        good = np.array([broken.isdisjoint(parts) for parts in cut], bool)
    per_text = lambda: np.add.reduceat([*map(len, ids), 0], np.cumsum([0, *map(len, cut)])[:-1]) // 4 if texts else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(ids), "<i4"), per_text, good


def _digits(n: int) -> np.ndarray:
    """Row i: i's decimal digits, then zeros, and room for a separator."""
    out = np.zeros((n, len(str(n)) + 1), np.uint8)
    for i in range(n):
        out[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
    return out


class Joined:
    """The tokens of several documents over one range of bytes. borders: where documents end in it, from 0 on."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, borders: np.ndarray):
        self.a, self.b, self.borders = a, b, borders
        self.end_a, self.end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        if len(a) and not self.end_a[-1] == self.end_b[-1] == borders[-1]:
            raise ValueError("tokens and texts differ in length")
        self.is_a, self.is_b = (np.bincount(x, minlength=int(borders[-1]) + 1) for x in (self.end_a, self.end_b))
        self.is_cut, self.is_link = self.is_a & self.is_b, self.is_a | self.is_b
        self.sums = {k: np.cumsum(x) for k, x in (("a", self.is_a), ("b", self.is_b), ("groups", self.is_cut), ("links", self.is_link))}

    def per_document(self, what: str) -> np.ndarray:
        return np.diff(self.sums[what][self.borders])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each link the document, the places of A's and B's tokens, and the byte at which it ends."""
        end = np.flatnonzero(self.is_link)
        doc = np.repeat(np.arange(len(self.borders) - 1), self.per_document("links"))
        return doc, (self.sums["a"] - self.is_a)[end], (self.sums["b"] - self.is_b)[end], end

    def strings(self, digits_a: np.ndarray, digits_b: np.ndarray) -> list[bytes]:
        """Of each document `a1,a2|b1;a3|b2`: A's tokens of a group, then B's."""
        group = self.sums["groups"] - self.is_cut  # of a token by its end
        cuts = np.flatnonzero(self.is_cut)
        width = max(digits_a.shape[1], digits_b.shape[1])
        rows = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        for ids, end, digits, before, mark in (
            (self.a, self.end_a, digits_a, np.concatenate([[0], self.sums["b"][cuts]]), ord("|")),
            (self.b, self.end_b, digits_b, self.sums["a"][cuts], ord(";")),
        ):
            own = np.zeros((len(ids), width), np.uint8)
            own[:, : digits.shape[1]] = digits[ids]
            own[:, -1] = np.where(self.is_cut[end] > 0, mark, ord(","))
            rows[np.arange(len(ids)) + before[group[end]]] = own
        filled = rows != 0
        places = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
        flat = rows[filled].tobytes()
        at = places[self.sums["a"][self.borders] + self.sums["b"][self.borders]]
        return [flat[i : j - 1] for i, j in zip(at[:-1], at[1:], strict=True)]


def joined(tok_a: TokenizerA, tok_b: TokenizerB, texts: list[bytes | None]) -> tuple[np.ndarray, Joined]:
    """The places of the texts that have tokens, and these tokens."""
    mark = SPACE_MARK.encode()
    own = np.array([i for i, x in enumerate(texts) if x and mark not in x], np.int64)
    spaced = [" " + texts[i].decode() for i in own]
    told = [_encoded(t, spaced) for t in (tok_a, tok_b)]
    good = told[0][2] & told[1][2]
    a, b = (ids if good.all() else ids[np.repeat(good, per_text())] for ids, per_text, _ in told)
    size = np.array([len(texts[i]) + 1 for i in own], np.int64)[good]
    return own[good], Joined(a, b, tok_a.parts.size, tok_b.parts.size, np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))


def _kind(tok_a: TokenizerA, tok_b: TokenizerB) -> np.dtype:
    return np.dtype("<u4" if len(tok_a.bytes_of) * len(tok_b.bytes_of) <= 1 << 32 else "<u8")


def _linked(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tok_a, tok_b = tokenizers(path_a, path_b)
        digits = _digits(len(tok_a.bytes_of)), _digits(len(tok_b.bytes_of))
        base, kind = len(tok_b.bytes_of), _kind(tok_a, tok_b)
        for batch in slices(batches):
            n = batch.num_rows
            own, j = joined(tok_a, tok_b, text_bytes(batch.column("text")))
            doc, a, b, _ = j.links()
            product = len(tok_a.bytes_of) * base
            keys, times = np.unique(doc * product + j.a[a].astype(np.int64) * base + j.b[b], return_counts=True)
            at = np.searchsorted(keys, np.arange(len(own) + 1) * product)
            pairs = (keys % product).astype(kind)
            counts = np.zeros((4, n), np.int64)
            for row, what in zip(counts, ("a", "b", "groups", "links"), strict=True):
                row[own] = j.per_document(what)
            hashes, pair_bytes, time_bytes = [""] * n, [b""] * n, [b""] * n
            for i, s, lo, hi in zip(own, j.strings(*digits), at[:-1], at[1:], strict=True):
                hashes[i], pair_bytes[i], time_bytes[i] = hashlib.sha256(s).hexdigest(), pairs[lo:hi].tobytes(), times[lo:hi].astype("<u4").tobytes()
            columns = [batch.column("doc_id"), *[pa.array(c) for c in counts], pa.array(hashes, pa.string()), pa.array(pair_bytes, pa.binary()), pa.array(time_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> LINKS: counts, the hash of the groups, the document's distinct pairs (a * B's size + b, ascending) and how often each is linked."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_linked(path_a, path_b), LINKS)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> a row per link: doc_id, a, b (ids), place_a, place_b (of the tokens in the document), start, stop (bytes of the space and the text in which both lie)."""

    def run(batches):
        tok_a, tok_b = tokenizers(path_a, path_b)
        for batch in slices(batches):
            own, j = joined(tok_a, tok_b, text_bytes(batch.column("text")))
            doc, a, b, stop = j.links()
            first, before = j.borders[doc], np.concatenate([[0], stop[:-1]])
            ids = batch.column("doc_id").take(pa.array(own[doc]))
            columns = [j.a[a], j.b[b], a - j.sums["a"][first], b - j.sums["b"][first], before - first, stop - first]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in columns]], ["doc_id", "a", "b", "place_a", "place_b", "start", "stop"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a long, b long, place_a long, place_b long, start long, stop long")


def _merged(held: tuple[np.ndarray, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    more, n = np.unique(pairs, return_counts=True)
    keys, at = np.unique(np.concatenate([held[0], more]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([held[1], n]), len(keys)).astype(np.int64)


def pair_counts(links: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """links -> pair, a, n (documents that hold it linked), best (no pair of this a has more)."""

    def run(batches):
        kind = _kind(*tokenizers(path_a, path_b))
        held = empty = np.empty(0, kind), np.empty(0, np.int64)
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1])], ["pair", "n"])
        for batch in slices(batches, "pairs"):
            held = _merged(held, np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind))
            if len(held[0]) > COUNTED:
                yield out(held)
                held = empty
        yield out(held)

    base = len(tokenizers(path_a, path_b)[1].bytes_of)
    counts = links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.select("pair", F.floor(F.col("pair") / base).alias("a"), "n"), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def _ranges(per_id: list[tuple[int, int]], block: int) -> list[tuple[int, int]]:
    """(first, last) ids of A for each block; a block ends where one more id would make it too large."""
    out, first, held = [], 0, 0
    for a, n in per_id:
        if held and held + n > block:
            out.append((first, a - 1))
            first, held = a, 0
        held += n
    return [*out, (first, 1 << 40)]


def _scored(block, first: int, last: int, base: int, kind: np.dtype) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the block's part to n_best and count_sum."""

    def run(batches):
        known, n, best = block.value
        for batch in slices(batches, "pairs"):
            raw = batch.column("pairs").to_pylist()
            doc = np.repeat(np.arange(len(raw)), [len(x) // kind.itemsize for x in raw])
            pairs = np.frombuffer(b"".join(raw), kind)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            inside = (pairs >= first * base) & (pairs < (last + 1) * base)
            doc, pairs, times = doc[inside], pairs[inside], times[inside]
            at = np.searchsorted(known, pairs)
            ends = np.searchsorted(doc, np.arange(len(raw) + 1))
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            for name, more in (("n_best", total(times * best[at])), ("count_sum", total(times * n[at]))):
                i = batch.schema.get_field_index(name)
                batch = batch.set_column(i, name, pa.array(batch.column(i).to_numpy() + more))
            yield batch

    return run


def alignment(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, (tok_a, tok_b) = docs.sparkSession, tokenizers(path_a, path_b)
    base, kind = len(tok_b.bytes_of), _kind(tok_a, tok_b)
    links = stored(linked(docs, path_a, path_b), "links")
    counts = stored(pair_counts(links, path_a, path_b), "counts")
    # a row per id of A: bounded by the vocabulary
    ranges = _ranges([tuple(r) for r in counts.groupBy("a").count().orderBy("a").collect()], block)
    rows = links.withColumns({c: F.lit(0).cast("long") for c in ("n_best", "count_sum")})
    for i, (first, last) in enumerate(ranges):
        found = counts.where(F.col("a").between(first, last)).select("pair", "n", "best").toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast((found.column("pair").to_numpy().astype(kind), found.column("n").to_numpy(), found.column("best").to_numpy().astype(np.int64)))
        rows = rows.mapInArrow(_scored(held, first, min(last, len(tok_a.bytes_of) - 1), base, kind), rows.schema)
        if i + 1 < len(ranges):
            rows = stored(rows, "scored")
            held.unpersist()
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

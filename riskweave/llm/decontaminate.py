"""Benchmark decontamination by winnowing.

Words are runs of [0-9a-z] and of characters from U+0080 on, after lower-casing A-Z. From the
hashes of each text's K-word grams, the least of each W consecutive ones is kept, on both sides.
Two texts that share K + W - 1 = 13 words in a row select the same gram in there, so every shared
13-word window has a common fingerprint. Training fingerprints are looked up among those of the test
texts; a hit is extended to all windows that hold it, and those that are whole windows of an item
count. An item of fewer words is one window: the hash of all its words is looked up among the grams
of that length.

Test items of up to BROADCAST bytes are dealt into blocks (an item above their size in overlapping parts),
each indexed once as sorted arrays and broadcast; a task takes its texts through them, so rows never meet
in a shuffle, and results do not depend on the number of blocks. Beyond that size the index is built in
tasks and the fingerprints are joined: texts hand on only those of theirs that a Bloom filter of the test
fingerprints lets pass, of bounded size; texts with a true hit extend it to whole windows, and these are
joined with the windows of the items. Both ways give the same rows. Work is in proportion to the words on
either side, whatever repeats.

Cases: null and empty texts have no words; null and empty items have no window; items of one id count
once; words of items without an id are hits, but no item is named for them. Repeated rows, and rows without doc_id, give a result row each; empty tables give an empty
result, or no hits. Very long texts are taken whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, mixed, slices, stored, text_bytes

WINDOW = 13
K = W = 7
#: Benchmark text in a block, and in all blocks that are broadcast.
BLOCK_BYTES, BROADCAST = 16 << 20, 64 << 20
#: Bits of the filter that spares most fingerprints the join; it only lets too many pass when it is full.
FILTER_BITS = 1 << 26
SCHEMA = "n_words long, starts array<int>, ends array<int>, items array<string>"

#: Fixed: A-Z to a-z, and bytes that are not part of a word to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def winnowed(h: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams kept: the leftmost least of each w consecutive ones, of all if there are fewer."""
    g = grams(h, k)
    if not len(g):
        return np.empty(0, np.int64), g
    view = np.lib.stride_tricks.sliding_window_view(g, min(w, len(g)))
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, g[at]


class Fingerprints:
    """What one block of benchmark items is looked up by, as sorted arrays: fingerprints, whole windows with their items, and items that are shorter than a window, by their length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        hashes, names = WordHashes(), {}
        prints, by_size = [], defaultdict(list)
        for item, words in items:
            h, owner = hashes.of(words), names.setdefault(item, len(names))
            if len(h) >= WINDOW:
                prints.append(winnowed(h)[1])
            g = grams(h, min(len(h), WINDOW)) if len(h) else h
            by_size[min(len(h), WINDOW)].append(np.rec.fromarrays([g, np.full(len(g), owner, np.int32)], names="hash,owner"))
        self.names = list(names)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        pairs = {m: np.unique(np.concatenate(v)) for m, v in by_size.items() if m}
        self.windows = {m: (np.ascontiguousarray(v["hash"]), np.ascontiguousarray(v["owner"])) for m, v in pairs.items()}

    def spans(self, h: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], set[str]]:
        """Starts and length of the document's windows that are windows of items, and those items."""
        found, items = [], set()
        for m, (ordered, owners) in self.windows.items():
            if m < WINDOW:
                g = grams(h, m)
                at = np.arange(len(g))
            else:
                at, g = winnowed(h)
                at = at[_among(g, self.prints)]
                if not len(at):
                    continue
                # a hit is extended to all windows that hold its gram
                at = np.unique(at[:, None] - np.arange(WINDOW - K + 1))
                at = at[(at >= 0) & (at <= len(h) - WINDOW)]
                g = grams(h, WINDOW)[at] if len(at) else h[:0]
            hit = _among(g, ordered)
            if hit.any():
                found.append((at[hit], m))
                same = np.unique(g[hit])
                for i, j in zip(np.searchsorted(ordered, same, "left"), np.searchsorted(ordered, same, "right"), strict=True):
                    items.update(owners[i:j].tolist())
        return found, {self.names[i] for i in items} - {None}


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def covered(n: int, found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of places below n that the windows cover."""
    edges = np.zeros(n + 1, np.int64)
    for at, m in found:
        np.add.at(edges, at, 1)
        np.add.at(edges, at + m, -1)
    inside = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _scanner(blocks: list, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches):
        hashes, none = WordHashes(), np.empty(0, np.int32)
        for batch in slices(batches):
            words = [hashes.of(words_of(t)) for t in text_bytes(batch.column("text"))]
            found, items = [[] for _ in words], [set() for _ in words]
            for block in blocks:  # one after the other for all these texts
                index = block.value
                for i, h in enumerate(words):
                    if len(h):
                        more, named = index.spans(h)
                        found[i] += more
                        items[i] |= named
            spans = [covered(len(h), f) if f else (none, none) for h, f in zip(words, found, strict=True)]
            columns = [pa.array(list(map(len, words)), pa.int64())] + [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)] + [pa.array(list(map(sorted, items)), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], [*kept, "n_words", "starts", "ends", "items"])

    return scan


def _blocks(items: Iterator, size: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items as (name, words) in blocks of about `size` bytes; an item above it is cut, with an overlap by which no window is lost."""
    block, held = [], 0
    for r in items:
        words, start = words_of(r.text.encode()), 0
        while start == 0 or start + WINDOW - 1 < len(words):
            part, n = [], 64
            for w in words[start:]:
                if n > size and len(part) >= WINDOW:
                    break
                part.append(w)
                n += len(w) + 1
            if block and held + n > size:
                yield block
                block, held = [], 0
            block.append((r.item, part))
            held += n
            start += len(part) - WINDOW + 1 if start + len(part) < len(words) else len(words) + 1
    if block:
        yield block


def _size(n: int) -> int:
    """Length of an item's windows: 0 stands for whole windows, whose fingerprints are winnowed grams; a shorter item has its own."""
    return 0 if n >= WINDOW else n


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> size, at (fingerprint), window (hash), item: a row for each window, with the fingerprints of the whole item beside the first ones."""
    hashes = WordHashes()
    for batch in slices(batches):
        for item, text in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text")), strict=True):
            h = hashes.of(words_of(text))
            if not len(h):
                continue
            size = _size(len(h))
            window = np.unique(grams(h, WINDOW if not size else size))
            at = np.unique(winnowed(h)[1]) if not size else window
            n = max(len(window), len(at))
            filled = lambda x: pa.array(np.pad(x, (0, n - len(x))).view(np.int64), pa.int64(), mask=np.arange(n) >= len(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), filled(at), filled(window), pa.array([item] * n, pa.string())], ["size", "at", "window", "item"])


def _places(h: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text's fingerprints: size, places and hashes."""
    for size in sizes:
        if size and len(h) >= size:
            g = grams(h, size)
            yield size, np.arange(len(g)), g
        elif not size and len(h) >= WINDOW:
            yield size, *winnowed(h)


def _bits(x: np.ndarray) -> list[np.ndarray]:
    x = mixed(x)
    return [(x >> np.uint64(s) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (0, 28)]


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_bits(batch.column("at").to_numpy().view(np.uint64))))
        slot, start = np.unique(at >> 5, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), start) if len(at) else at)], ["slot", "word"])


def _joined(source: DataFrame, items: DataFrame, kept: list[str]) -> DataFrame:
    """contamination's rows by joins of fingerprints and of windows."""
    spark = source.sparkSession
    index = stored(items.mapInArrow(_hashes, "size int, at long, window long, item string"), "windows")
    prints = stored(index.where("at is not null").select("size", "at").distinct(), "prints")
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())  # WINDOW of them at most
    words = np.zeros(FILTER_BITS // 32, "<u4")
    set_bits = prints.select("at").mapInArrow(_filter_words, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    words[set_bits.column("slot").to_numpy()] = set_bits.column("word").to_numpy()
    held = spark.sparkContext.broadcast(words)
    rows = stored(source.withColumn("_row", F.monotonically_increasing_id()), "texts")  # writing fixes the numbers

    def likely(batches):
        hashes, filled = WordHashes(), held.value
        for batch in slices(batches):
            out = []
            for row, text in zip(batch.column("_row").to_pylist(), text_bytes(batch.column("text")), strict=True):
                for size, _, g in _places(hashes.of(words_of(text)), sizes):
                    g = np.unique(g)
                    g = g[np.logical_and.reduce([filled[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1 for at in _bits(g)])]
                    if len(g):
                        out.append((np.full(len(g), row), np.full(len(g), size, np.int32), g.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["_row", "size", "at"])

    hits = rows.select("_row", "text").mapInArrow(likely, "_row long, size int, at long").join(prints, ["size", "at"], "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_list(F.struct("size", "at")).alias("hits"))  # a text's own fingerprints

    def extended(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            out = []
            for row, text, found in zip(batch.column("_row").to_pylist(), text_bytes(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
                h = hashes.of(words_of(text))
                true = {}
                for x in found:
                    true.setdefault(x["size"], []).append(x["at"])
                for size, at, g in _places(h, list(true)):
                    at = at[np.isin(g, np.array(true[size], np.int64).view(np.uint64))]
                    if not size:  # a hit is extended to all windows that hold its gram
                        at = np.unique(at[:, None] - np.arange(WINDOW - K + 1))
                        at = at[(at >= 0) & (at <= len(h) - WINDOW)]
                    window = grams(h, size or WINDOW)[at]
                    out.append((np.full(len(at), row), np.full(len(at), size, np.int32), at.astype(np.int64), window.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["_row", "size", "place", "window"])

    windows = stored(rows.select("_row", "text").join(hits, "_row").mapInArrow(extended, "_row long, size int, place long, window long"), "found")
    index = index.where("window is not null").select("size", "window", "item")
    spans = windows.join(index.select("size", "window").distinct(), ["size", "window"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("place", "size")).alias("spans"))
    named = windows.select("_row", "size", "window").distinct().join(index.where("item is not null"), ["size", "window"]).groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))

    def told(batches):
        for batch in slices(batches):
            n = [len(words_of(t)) for t in text_bytes(batch.column("text"))]
            found = [[(np.array([x["place"]]), x["size"] or WINDOW) for x in s or ()] for s in batch.column("spans").to_pylist()]
            runs = [covered(k, f) for k, f in zip(n, found, strict=True)]
            items = [x or [] for x in batch.column("items").to_pylist()]
            columns = [pa.array(n, pa.int64()), *[pa.array([r[k] for r in runs], pa.list_(pa.int32())) for k in (0, 1)], pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], [*kept, "n_words", "starts", "ends", "items"])

    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), SCHEMA])
    return rows.join(spans, "_row", "left").join(named.withColumnRenamed("_row", "_named"), F.col("_row") == F.col("_named"), "left").select(*dict.fromkeys([*kept, "text", "spans", "items"])).mapInArrow(told, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = (), broadcast: int = BROADCAST) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, n_hit, starts and ends of the hit word spans, items (sorted ids as strings); and the columns in carry (other names than these), each row with its own. broadcast: the bytes of items up to which they are broadcast."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    carry = [c for c in carry if c != "doc_id"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in carry if c != "text"])
    kinds, kept = dict(source.dtypes), ["doc_id", *carry]
    if (items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) > broadcast:
        found = _joined(source, items, kept)
    else:
        blocks = [sc.broadcast(Fingerprints(block)) for block in _blocks(items.toLocalIterator(), block_bytes)]
        found = source.mapInArrow(_scanner(blocks, kept), ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in carry), SCHEMA]))
    spread = F.aggregate(F.zip_with("ends", "starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", *carry, "n_words", spread.alias("n_hit"), "starts", "ends", "items")


def contaminated():
    """The rule on n_hit and n_words: a twentieth of the words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

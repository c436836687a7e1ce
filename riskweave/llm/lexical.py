"""Ranked lexical search over document-sharded postings with integer impacts.

Documents are dealt into shards as they lie, without a shuffle: a shard is what a task reads until it
holds SHARD_BYTES of text. It keeps its sorted vocabulary, and for each term the places of the documents
that hold it and their impacts, in compressed sparse rows (`starts`, `places`, `impacts`). An impact is
the part of a score that does not depend on the query, with the document's length in it, so a search
only multiplies by the term's weight and adds.

A search takes the queries in blocks of bounded size. For a block, one pass over vocabularies sums the
document frequencies of its terms, and one pass over postings scores: in each shard, term at a time, a
dense accumulator of one number per document; of it argpartition finds the k-th best score, and of the
documents with just that score those with the least ids are taken. A task keeps the k best of a query
over all its shards, so it returns k rows a query; these are merged in two steps, so that no group grows
with the number of tasks.

Cases: null texts, and texts without a term, are in the index and never found; they do not count in N.
Queries without a term find nothing. Rows that repeat an id are documents of their own, each with its
rank; equal scores go by ascending doc_id, null ids last. Queries that share an item_id are ranked each
on its own. Very long texts are taken whole and make a shard alone. Empty tables give an empty result.
Columns besides doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

#: Text of a shard, and text of a block of queries: the bound of a broadcast.
SHARD_BYTES, QUERY_BYTES = 8 << 20, 4 << 20
#: Fixed: scale of an impact, how it saturates, and the length's share, in hundredths.
SCALE, PER_USE, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 12, 25
#: Groups in which tasks' results are merged first.
SLOTS = 64
SHARD = "n_docs int, doc_ids binary, has_id binary, terms array<binary>, starts binary, places binary, impacts binary"

#: Letters, digits and all that is not ASCII make terms; A-Z become small, the rest blanks.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_INSIDE = np.frombuffer(_TERM, np.uint8) != 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def n_terms(column: pa.Array) -> np.ndarray:
    """Of each text the number of its terms, counted over the bytes of all texts at once."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets - offsets[0]
    heads = at[:-1][np.diff(at) > 0]
    first[heads] = inside[heads]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[at])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, total = 0, 0
    for batch in slices(batches):
        n = n_terms(batch.column("text"))
        docs, total = docs + int(np.count_nonzero(n)), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """tf, n: a term's uses in documents and the documents' numbers of terms, as 64-bit integers."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // max(total, 1)
    return SCALE * tf // (PER_USE * tf + PER_LENGTH * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class ShardMaker:
    """Documents until they make a shard."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total = docs, total
        self._clear()

    def _clear(self) -> None:
        self.size, self.ids, self.lengths, self.parts, self.vocabulary = 0, [], [], [], {}

    def add(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        known = self.vocabulary
        for text in texts:
            words = terms(text or b"")
            for w in words:
                if w not in known:
                    known[w] = len(known)
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            self.lengths.append(len(words))
            self.size += len(text or b"")
        self.ids += ids

    def row(self) -> pa.RecordBatch:
        n = np.array(self.lengths, np.int64)
        order = sorted(self.vocabulary)
        rank = np.empty(len(order), np.int64)
        rank[np.fromiter(map(self.vocabulary.__getitem__, order), np.int64, len(order))] = np.arange(len(order))
        own = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        keys, tf = np.unique(rank[own] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, place = keys // max(len(n), 1), keys % max(len(n), 1)
        starts = np.searchsorted(term, np.arange(len(order) + 1))
        has = np.array([x is not None for x in self.ids], bool)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.array([len(n)], pa.int32()), pa.array([ids.tobytes()]), pa.array([has.tobytes()]), pa.array([order], pa.list_(pa.binary())), *[pa.array([x.astype("<i4").tobytes()]) for x in (starts, place, impact(tf, n[place], self.docs, self.total))]],
            ["n_docs", "doc_ids", "has_id", "terms", "starts", "places", "impacts"],
        )
        self._clear()
        return out


def _shards(docs: int, total: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        maker = ShardMaker(docs, total)
        for batch in slices(batches):
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if maker.ids and maker.size + size > most:
                yield maker.row()
            maker.add(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")))
        if maker.ids:
            yield maker.row()

    return run


class Index:
    """The shards' table, the number of documents with a term, and that of all terms."""

    def __init__(self, shards: DataFrame, docs: int, total: int):
        self.shards, self.docs, self.total = shards, docs, total


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """docs (doc_id, text): one pass counts terms, one writes the shards to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.select("text").mapInArrow(_lengths, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).head()
    n, total = got.docs or 0, got.total or 0
    # a row is a shard of megabytes: its size is looked at after each row, not after 100, so that a row group, which is held as one where it is written and read, has few of them
    groups = {"parquet.block.size": 2 * shard_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    return Index(stored(rows.mapInArrow(_shards(n, total, shard_bytes), SHARD), "shards", **groups), n, total)


def _frequencies(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        known = pa.array(wanted.value, pa.binary())
        out = np.zeros(len(known), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms"), batch.column("starts").to_pylist(), strict=True):
                at = pc.index_in(own.values.cast(pa.binary()), value_set=known)
                held = pc.is_valid(at).to_numpy(zero_copy_only=False)
                out[pc.drop_null(at).to_numpy()] += np.diff(np.frombuffer(starts, "<i4"))[held]
        hit = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(out[hit])], ["term", "df"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, has: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0, highest first, equal ones by id, null ids last. argpartition finds the k-th best score; all documents with more are in, and those with just that score are ordered before they are cut."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        last = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        more, same = at[own > last], at[own == last]
        same = same[np.lexsort((ids[same], ~has[same]))][: k - len(more)]
        at = np.concatenate([more, same])
    return at[np.lexsort((ids[at], ~has[at], -scores[at]))]


def _searched(block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the shards' table -> the k best documents of each query over all shards of the task."""

    def run(batches):
        words, weights, queries = block.value
        known = pa.array(words, pa.binary())
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
                ids, has, starts, places, impacts = get("doc_ids", "<i8"), get("has_id", bool), get("starts", "<i4"), get("places", "<i4"), get("impacts", "<i4")
                at = pc.index_in(batch.column("terms")[i].values.cast(pa.binary()), value_set=known)
                rows = np.full(len(known), -1)
                rows[pc.drop_null(at).to_numpy()] = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                for q, (_, own, times) in enumerate(queries):
                    scores = np.zeros(len(ids), np.int64)
                    for t, n in zip(own, times, strict=True):
                        if (r := rows[t]) >= 0:
                            part = slice(starts[r], starts[r + 1])
                            scores[places[part]] += impacts[part] * np.int64(n * weights[t])
                    if len(top := best(scores, ids, has, k)):
                        both = [np.concatenate(x) for x in zip(held[q], (scores[top], ids[top], has[top]), strict=True)]
                        top = best(*both, k)
                        held[q] = tuple(x[top] for x in both)
        numbers = np.repeat(np.array([x[0] for x in queries], np.int64), [len(x[0]) for x in held])
        score, ids, has = (np.concatenate(x) for x in zip(*held, strict=True))
        task = np.full(len(ids), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(task), pa.array(ids, mask=~has), pa.array(score)], ["query", "task", "doc_id", "score"])

    return run


def _top(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries (item_id, text) -> item_id, rank (from 1), doc_id, score: the k best documents of each query."""
    spark = queries.sparkSession
    rows = queries.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # numbers and blocks are fixed by writing the table; a block is a range of places in a task's rows
    rows = stored(rows.select("item_id", "text", F.monotonically_increasing_id().alias("query")), "queries")
    earlier = Window.partitionBy(F.shiftright("query", 33)).orderBy("query").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("part", F.floor(F.sum(F.octet_length("text")).over(earlier) / query_bytes))
    sized = stored(sized.withColumn("block", F.struct(F.shiftright("query", 33).alias("task"), "part")), "blocks")
    found = None
    # the blocks' names: one for QUERY_BYTES of queries
    for r in sized.select("block").distinct().orderBy("block").collect():
        got = sized.where((F.col("block.task") == r.block.task) & (F.col("block.part") == r.block.part)).select("query", F.encode("text", "utf-8").alias("text")).collect()
        uses = [(x.query, Counter(terms(bytes(x.text)))) for x in got]
        words = sorted({w for _, u in uses for w in u})
        number = {w: i for i, w in enumerate(words)}
        wanted = spark.sparkContext.broadcast(words)
        df = dict(index.shards.select("terms", "starts").mapInArrow(_frequencies(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect())
        weights = [weight(df[i], index.docs) if i in df else 0 for i in range(len(words))]
        asked = [(q, [number[w] for w in u], list(u.values())) for q, u in uses]
        held = spark.sparkContext.broadcast((words, weights, asked))
        own = index.shards.mapInArrow(_searched(held, k), "query long, task int, doc_id long, score long")
        own = stored(_top(_top(own, ["query", F.pmod("task", F.lit(SLOTS))], k).drop("rank"), ["query"], k), "ranked")
        wanted.unpersist()
        held.unpersist()
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "query long, task int, doc_id long, score long, rank int")
    return found.join(rows.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")

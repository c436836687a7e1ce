"""Helpers that several operators share: shared-folder tables, text slicing and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task, so that a task's memory does not follow Arrow's batch size.
SLICE_BYTES = 1 << 20
#: Entries of a task's word cache before it starts anew.
CACHE_WORDS = 400_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="riskweave-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/riskweave"


def stored(df: DataFrame, label: str, **options: object) -> DataFrame:
    """df written once as a Parquet table (with the writer's options) in the shared folder and read back: lineage ends here, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables made by stored() that no later plan reads."""
    for df in frames:
        if (path := getattr(df, "_stored_path", None)) is not None:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, split: int = 4 << 20) -> DataFrame:
    """Deals a table of less than `split` bytes a core over all cores, which its file splits would not fill; a larger one is read as it lies, without a shuffle. No result depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column`, one row at least."""
    for batch in batches:
        start, edges = 0, np.cumsum(_lengths(batch.column(column))) // most
        while start < batch.num_rows:
            end = int(np.searchsorted(edges, edges[start], side="right"))
            yield batch.slice(start, end - start)
            start = end


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class WordHashes(dict):
    """64-bit hashes of words, remembered; equal on every executor."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; none where there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out * GOLDEN) ^ mixed(h[i : i + n] + np.uint64(i + 1))
        out = out ^ (out >> np.uint64(29))
    return mixed(out)

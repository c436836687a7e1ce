"""Structured Streaming jobs: cached verdicts, counters, edges, keyed limits.

Keyed state ends when a key has been idle for a time that each function names, so it does not grow
with all keys ever seen. To look for idle keys, such streams run batches without data; a job that is
to end (availableNow) turns spark.sql.streaming.noDataMicroBatches.enabled off.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.sources.sinks import added, recovered, replaced, zero_counters

DAY = 86_400.0


def first_seen(stream: DataFrame, ts: str, ttl: str = "5 seconds") -> DataFrame:
    """Contents whose text was not seen within ttl of its first sight; the watermark bounds the state."""
    return stream.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["digest"])


def answering(cache: str, answers: str, scan: Callable[[DataFrame], DataFrame], ttl: float = 5.0, version: Callable[[], str] = lambda: "", clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function on rows (content_id, text, more): each row gets a verdict, one held for its text within ttl seconds or that of a scan, which sees each new text once. scan: (content_id, text) -> content_id, verdict columns. Answers go to a folder of their own for each batch, so a batch that runs again replaces its own. version names the rules in force; verdicts of other rules are not used."""

    def answer(batch: DataFrame, number: int) -> None:
        spark, now, rules = batch.sparkSession, clock(), version()
        keyed = batch.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
        held = None
        if recovered(spark, cache):
            held = spark.read.parquet(cache).where((F.lit(now) - F.col("_at") <= ttl) & (F.col("_rules") == rules))
            texts = texts.join(held, "digest", "left_anti")
        fresh = scan(texts.select(F.col("digest").alias("content_id"), "text")).withColumnRenamed("content_id", "digest").withColumns({"_at": F.lit(float(now)), "_rules": F.lit(rules)})
        replaced(fresh if held is None else held.unionByName(fresh), cache)
        verdicts = spark.read.parquet(cache).drop("_at", "_rules")
        keyed.join(verdicts, "digest").drop("digest").write.mode("overwrite").parquet(f"{answers}/batch={number}")

    return answer


def windowed_counts(stream: DataFrame, ts: str, kind: str, size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), kind).count()


def flush_into(path: str, counters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's counters to the table at path. The batch's number is kept beside the sums, so a batch that runs again adds nothing, and a flush that was cut off is ended or undone first."""

    def flush(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held, last = zero_counters(spark), -1
        if recovered(spark, path):
            held = spark.read.parquet(path)
            last = held.head()["last_batch"]
            held = held.drop("last_batch")
        if number > last:
            replaced(added(held, counters(batch)).withColumn("last_batch", F.lit(number).cast("long")), path)

    return flush


def _keyed(stream: DataFrame, key: str, columns: list[str], added: str, step: Callable, idle: float, state: str) -> DataFrame:
    """Rows of each key in order of columns[0] through step(held or None, values) -> (answer, held); the state is dropped after idle seconds without a row. The order holds within a trigger, whose rows of a key are gathered, however many Arrow batches they come in; event_order has it across triggers."""
    kinds = dict(stream.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(columns[0], kind="stable")
        out = []
        for values in zip(*(rows[c] for c in columns), strict=True):
            said, now = step(now, *values)
            out.append(said)
        yield rows[[key, *columns]].assign(**{added: pd.Series(out, dtype="bool", index=rows.index)})
        if now is not None:
            held.update(tuple(now))
        held.setTimeoutDuration(int(max(idle, 1.0) * 1000))

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *columns)]) + f", {added} boolean"
    return stream.select(key, *columns).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def limited(stream: DataFrame, key: str, seconds: str, rate: float, burst: float) -> DataFrame:
    """With allowed: a token bucket per key over a stream. After the time in which a bucket fills up its state says nothing, and is dropped."""
    if rate <= 0:
        return stream.select(key, seconds, F.lit(True).alias("allowed"))
    burst = max(burst, 1.0)

    def step(held, t):
        tokens, last = held if held is not None else (burst, t)
        tokens = min(burst, tokens + max(0.0, t - last) * rate)
        return tokens >= 1, (float(tokens - (tokens >= 1)), float(t))

    return _keyed(stream, key, [seconds], "allowed", step, burst / rate, "held double, last double")


def increasing_ids(stream: DataFrame, key: str, number: str, idle: float = DAY) -> DataFrame:
    """Rows with rejected: the number is not above the key's largest so far (within idle seconds of its last row). Rows of a batch are taken in order of arrival."""
    kinds = dict(stream.dtypes)

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most = state.get[0] if state.exists else 0
        for batch in batches:
            out = []
            for n in batch[number]:
                out.append(n <= most)
                most = max(most, n)
            yield pd.DataFrame({key: batch[key], number: batch[number], "rejected": out})
        state.update((int(most),))
        state.setTimeoutDuration(int(max(idle, 1.0) * 1000))

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{number}` long, rejected boolean", "most long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tamper_edges(stream: DataFrame, key: str, seconds: str, ok: str, idle: float = DAY) -> DataFrame:
    """With edge: ok turned false. Before a key's first row all was well; a null counts as ok."""

    def step(held, t, fine):
        fine = True if fine is None or pd.isna(fine) else bool(fine)
        return (held is None or held[0]) and not fine, (fine,)

    return _keyed(stream, key, [seconds, ok], "edge", step, idle, "ok boolean")


def throttled(stream: DataFrame, key: str, seconds: str, mark: str, gap: float = 1.5, idle: float = DAY) -> DataFrame:
    """With accepted: not within gap of the last accepted row, and not with its mark (a string)."""

    def step(held, t, m):
        said = held is None or (t - held[0] >= gap and m != held[1])
        return said, (float(t), m) if said else held

    return _keyed(stream, key, [seconds, mark], "accepted", step, idle, "last double, mark string")


def hello_once(stream: DataFrame, key: str, seconds: str, idle: float = DAY) -> DataFrame:
    """With hello: true for a connection's first row only."""
    return _keyed(stream, key, [seconds], "hello", lambda held, t: (held is None, (True,)), idle, "seen boolean")

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from riskweave.operators import ordered
from riskweave.streaming import event_order

SCHEMA = "k string, at timestamp, n long, ok boolean, mark string"


@pytest.fixture(scope="module")
def rows(spark):
    """Times that repeat, a key with most rows, a null key, and nulls in what the rules look at."""
    rng = random.Random(4)
    out = [(rng.choice(["hot", "hot", "hot", "b", None]), 1_000_000 + rng.randrange(4000) / 4, i, rng.choice([True, False, None]), rng.choice(["x", "y", None])) for i in range(600)]
    return spark.createDataFrame(out, "k string, s double, n long, ok boolean, mark string").select("k", F.timestamp_seconds("s").alias("at"), "n", "ok", "mark").cache()


def told(df, column):
    return sorted((str(r.k), r.n, r[column]) for r in df.collect())


@pytest.fixture(params=[2, 10_000])
def batches(spark, request):
    """Rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("shuffled", [False, True])
def test_streams_agree_with_batch_rules(spark, rows, batches, shuffled):
    """Whatever the batch's size and the order of arrival, the answers are those of the operators on tables."""
    if (batches == 2) != shuffled:  # two of the four runs say it all
        return
    mine = rows.orderBy(F.rand(7)) if shuffled else rows
    timed = rows.withColumn("s", F.col("at").cast("double"))
    run = lambda job: event_order.replayed(mine, "at", job, 400.0, slices=2)
    late = {"late": "400 seconds"}
    assert told(run(lambda s: event_order.limited(s, "k", "at", "n", 0.05, 3.0, **late)), "allowed") == told(ordered.token_bucket(timed, "k", "s", "n", 0.05, 3.0), "allowed")
    if shuffled:
        return
    assert told(run(lambda s: event_order.throttled(s, "k", "at", "n", "mark", 2.0, **late)), "accepted") == told(ordered.throttled(timed, "k", "s", "n", "mark", 2.0), "accepted")
    edges = told(run(lambda s: event_order.edges(s, "k", "at", "n", "ok", **late)).where("edge"), "n")
    assert edges == told(ordered.bad_edges(rows, "k", "at", "ok", "n"), "n")
    hello = told(run(lambda s: event_order.hello_once(s, "k", "at", "n", **late)).where("hello"), "n")
    first = rows.groupBy("k").agg(F.min(F.struct("at", "n")).alias("f")).select("k", "f.n")
    assert hello == told(first, "n")


@pytest.mark.parametrize("slices", [1, 3])
def test_idle_keys_are_forgotten(spark, slices):
    """Also where the rows before and after come in one batch."""
    at = lambda s: F.timestamp_seconds(F.lit(1_000_000 + s))
    parts = [spark.range(1).select(F.lit("a").alias("k"), at(s).alias("at"), F.lit(n).cast("long").alias("n"), F.lit(False).alias("ok"), F.lit("x").alias("mark")) for n, s in enumerate([0, 30, 500])]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = event_order.replayed(rows, "at", lambda s: event_order.hello_once(s, "k", "at", "n", late="10 seconds", idle=100.0), 10.0, slices=slices)
    assert sorted((r.n, r.hello) for r in out.collect()) == [(0, True), (1, False), (2, True)]


class Plain:
    """A cache as a list of entries, the one used last at the end."""

    def __init__(self, capacity, ttl):
        self.capacity, self.ttl, self.held = capacity, ttl, OrderedDict()

    def ask(self, digest, who, now):
        if digest in self.held and now - self.held[digest][1] <= self.ttl:
            self.held.move_to_end(digest)
            return True, self.held[digest][0]
        self.held.pop(digest, None)
        self.held[digest] = (who, now)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return False, who


def test_cache_cases():
    second = 1_000_000
    cache = event_order.Cache(2, 5.0)
    assert cache.ask("a", "1", 0) == (False, "1", False)
    assert cache.ask("a", "2", 5 * second) == (True, "1", False)  # a hit does not make it live longer
    assert cache.ask("a", "3", 5 * second + 1) == (False, "3", False)
    cache.ask("b", "4", 6 * second)
    assert cache.ask("a", "5", 6 * second)[:2] == (True, "3")  # now b is the one used longest ago
    assert cache.ask("c", "6", 6 * second) == (False, "6", True)
    assert cache.ask("b", "7", 6 * second) == (False, "7", True)
    assert (cache.hits, cache.misses, cache.evictions) == (2, 5, 2)
    again = event_order.Cache(2, 5.0, cache.state())
    assert again.state() == cache.state() and again.ask("c", "8", 7 * second)[0]
    assert (event_order.Cache(0, -1.0).capacity, event_order.Cache(0, -1.0).ttl) == (event_order.CAPACITY, 5 * second)


def test_cached_stream_with_a_small_capacity(spark):
    rng = random.Random(9)
    asked = [(f"r{i:04d}", 1_000_000 + i / 10, rng.choice(["", "a", "b", "c", "d", None, "e"])) for i in range(300)]
    rows = spark.createDataFrame(asked, "who string, s double, text string").select("who", F.timestamp_seconds("s").alias("at"), "text")
    out = event_order.replayed(rows, "at", lambda s: event_order.cached(s, "at", "who", capacity=3, ttl=2.0), 10.0)
    plain = Plain(3, 2_000_000)
    right = [(who, *plain.ask(text or "", who, round(s * 1e6))) for who, s, text in asked]
    assert sorted((r.who, r.hit, r.answered_by) for r in out.collect()) == right
    hits = sum(hit for _, hit, _ in right)
    (counts,) = event_order.cache_counts(out).collect()
    assert hits > 50 and (counts.hits, counts.misses) == (hits, 300 - hits) and counts.evictions == out.where("evicted").count() > 20


def test_a_key_with_several_arrow_batches_in_a_trigger(spark, tmp_path):
    """The job without a watermark sorts all rows of a key that one trigger brings."""
    from riskweave.streaming import jobs

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        spark.createDataFrame([("a", 2.0, False), ("a", 3.0, True), ("a", 0.0, False)], "k string, s double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, s double, ok boolean").parquet(str(tmp_path / "in"))
        jobs.tamper_edges(stream, "k", "s", "ok").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        assert [r.s for r in spark.read.parquet(str(tmp_path / "out")).where("edge").collect()] == [0.0]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_state_follows_buckets_and_not_rows(spark, tmp_path):
    rows = spark.range(6000).select((F.col("id") % 500).alias("k"), F.timestamp_seconds(1_000_000 + F.col("id") / 100).alias("at"), F.col("id").alias("n"), (F.col("id") % 3 == 0).alias("ok"))
    rows.write.parquet(str(tmp_path / "in"))
    job = event_order.edges(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "at", "n", "ok")
    query = job.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    # a bucket's waiting rows, what is held of its keys, its timer in two orders, and the time of that
    assert query.recentProgress[0].stateOperators[0].numRowsTotal <= 5 * 500


def test_keys_and_ties_that_hold_no_value(spark):
    """Keys that are null or NaN are one each, also where all keys share a bucket; ties are nulls first."""
    nan = float("nan")
    asked = [(k, 1_000_000.0 + t, n) for t in range(3) for n in (5, None) for k in (nan, None, 0.5)]
    rows = spark.createDataFrame(asked, "k double, s double, n long").select("k", F.timestamp_seconds("s").alias("at"), "n")
    out = event_order.replayed(rows, "at", lambda s: event_order.hello_once(s, "k", "at", "n", late="2 seconds"), 2.0)
    said = [(str(r.k), r.micros, r.n) for r in out.where("hello").collect()]
    assert out.count() == 18 and sorted(said) == [(k, 1_000_000_000_000, None) for k in ("0.5", "None", "nan")]

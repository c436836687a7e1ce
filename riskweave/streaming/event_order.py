"""Keyed rules over streams in order of event time, whatever the order of arrival.

Keys are dealt by hash over `BUCKETS` buckets, and a bucket is what Spark groups by: what reads and writes
state is a bucket's rows of a batch at once, not a row or a key, so the calls between Python and the state
store do not grow with rows or keys. Rows wait in list state until the watermark has passed their time; the
bucket's one timer then takes those that are due, sorts those of each key by time and the rule's further
order, and folds them into what is held of the key.
So answers depend neither on how rows are dealt over batches nor on the size of an Arrow batch, as long
as rows are late by no more than `late`; later ones are dropped, as everywhere in Structured Streaming.
What waits of a key are the rows of that time only, and what is held of it ends after `idle` seconds.

The state needs Spark's RocksDB store, which the functions ask for where the session names none.

Cases: null keys are one key; null times never pass the watermark and are dropped; equal times go by the
further order, nulls first, and rows equal in that, too, are all answered.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from riskweave.sources.sinks import shared_folder

DAY, MILLION = 86_400.0, 1_000_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt over; no answer depends on it.
BUCKETS = 2048
#: Fixed: how long a verdict is held, and how many a cache holds.
TTL, CAPACITY = 5.0, 1024


class InOrder(StatefulProcessor):
    """fold(held or None, rows sorted) -> (a tuple of answers for each row, held). A row is (micros, *values). names: the key's, the row's columns, the answers."""

    def __init__(self, fold: Callable, names: list[str], width: int, idle: float):
        self.fold, self.names, self.width, self.idle = fold, names, width, int(idle * MILLION)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "keys binary")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(rows)
        take = itemgetter(*map(first.__fields__.index, self.names[: self.width]))
        arrived = [take(first), *map(take, rows)]
        self.waiting.appendValue((pickle.dumps(arrived),))
        self._wake(-(-min(r[1] for r in arrived) // 1000))
        return iter(())

    def _wake(self, at: int) -> None:
        """A bucket has one timer, at the earliest time (in ms) that is asked for."""
        if (known := self.next.get()) is not None:
            if known[0] <= at:
                return
            self.handle.deleteTimer(known[0])
        self.next.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.next.clear()
        due, left = {}, []
        for (rows,) in self.waiting.get():
            for r in pickle.loads(rows):
                due.setdefault(_hashed(r[0]), []).append(r) if r[1] <= mark else left.append(r)
        known = self.held.get()
        held = pickle.loads(known[0]) if known is not None else {}
        said = Row(*self.names)
        for k, rows in due.items():
            name, own = rows[0][0], in_turn([r[1:] for r in rows])
            answers, now = self._folded(held.get(k), own)
            held[k] = (own[-1][0], *now)
            for r, a in zip(own, answers, strict=True):
                yield said(name, *r, *a)
        held = {k: v for k, v in held.items() if v[0] + self.idle > mark}
        self.held.update((pickle.dumps(held),)) if held else self.held.clear()
        self.waiting.put([(pickle.dumps(left),)]) if left else self.waiting.clear()
        ends = [-(-min(r[1] for r in left) // 1000)] if left else []
        ends += [(min(v[0] for v in held.values()) + self.idle) // 1000 + 1] if held else []
        if ends:
            self._wake(min(ends))

    def _folded(self, held: tuple | None, due: list[tuple]) -> tuple[list[tuple], tuple]:
        """A row that comes more than the idle time after the one before begins anew, whether or not a timer has fired between them."""
        last, now = (held[0], held[1:]) if held is not None else (due[0][0], None)
        answers, start = [], 0
        for i, r in enumerate(due):
            if r[0] - last > self.idle:
                if start < i:
                    answers += self.fold(now, due[start:i])[0]
                now, start = None, i
            last = r[0]
        more, now = self.fold(now, due[start:])
        return answers + more, now


def _hashed(key):
    """A key of a dict that is equal where Spark holds keys for equal: NaN equals itself."""
    return ("NaN",) if key != key else tuple(key) if isinstance(key, list) else key


def in_turn(rows: list[tuple]) -> list[tuple]:
    """Sorted, nulls first."""
    try:
        return sorted(rows)
    except TypeError:  # a null met a value
        return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def in_order(stream: DataFrame, key: str, ts: str, columns: list[str], answers: str, fold: Callable, late: str = "10 minutes", idle: float = DAY) -> DataFrame:
    """stream -> key, micros (of ts), columns, and the answers (a DDL string). columns after the time are the further order of rows at one time, as well as what fold sees."""
    spark = stream.sparkSession
    if spark.conf.get(_STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_STORE, ""):
        spark.conf.set(_STORE, ROCKSDB)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = stream.withWatermark(ts, late).select(bucket, key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), *columns).where("micros is not null")
    kinds = dict(rows.dtypes)
    taken = [key, "micros", *columns]
    names = [*taken, *(x.split()[0] for x in answers.split(", "))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in taken), answers])
    return rows.groupBy("_bucket").transformWithState(InOrder(fold, names, len(taken), idle), schema, "append", "EventTime").select(*names)


def limited(stream: DataFrame, key: str, ts: str, tie: str, rate: float, burst: float, late: str = "10 minutes") -> DataFrame:
    """With allowed: a token bucket per key; what is held ends when the bucket would be full. A rate of 0 or less allows all."""
    burst = max(burst, 1.0)

    def fold(held, rows):
        tokens, last = held if held is not None else (burst, rows[0][0])
        out = []
        for r in rows:
            tokens = min(burst, tokens + max(0, r[0] - last) / MILLION * rate) if rate > 0 else burst
            last, said = r[0], tokens >= 1
            tokens -= said
            out.append((said,))
        return out, (float(tokens), last)

    return in_order(stream, key, ts, [tie], "allowed boolean", fold, late, burst / rate if rate > 0 else 0.0)


def edges(stream: DataFrame, key: str, ts: str, tie: str, ok: str, late: str = "10 minutes", idle: float = DAY) -> DataFrame:
    """With edge: ok turned false. Before a key's first row all was well; a null counts as ok."""

    def fold(held, rows):
        fine, out = held is None or held[0], []
        for r in rows:
            now = r[2] is None or bool(r[2])
            out.append((fine and not now,))
            fine = now
        return out, (fine,)

    return in_order(stream, key, ts, [tie, ok], "edge boolean", fold, late, idle)


def throttled(stream: DataFrame, key: str, ts: str, tie: str, mark: str, gap: float = 1.5, late: str = "10 minutes", idle: float = DAY) -> DataFrame:
    """With accepted: not within gap seconds of the last accepted row, and not with its mark (a string)."""

    def fold(held, rows):
        out = []
        for r in rows:
            said = held is None or (r[0] - held[0] >= gap * MILLION and r[2] != held[1])
            held = (r[0], r[2]) if said else held
            out.append((said,))
        return out, held

    return in_order(stream, key, ts, [tie, mark], "accepted boolean", fold, late, idle)


def hello_once(stream: DataFrame, key: str, ts: str, tie: str, late: str = "10 minutes", idle: float = DAY) -> DataFrame:
    """With hello: true for a connection's first row only."""
    return in_order(stream, key, ts, [tie], "hello boolean", lambda held, rows: ([(held is None and i == 0,) for i in range(len(rows))], (True,)), late, idle)


class Cache:
    """Verdicts' places by digest, the one used last at the end. A look-up that finds one held for ttl at most moves it to the end, but its time stays that of its insertion; one held for longer is dropped and counts as a miss. A miss is followed by an insertion, which drops the one used longest ago beyond the capacity."""

    def __init__(self, capacity: int = CAPACITY, ttl: float = TTL, held: tuple | None = None):
        self.capacity, self.ttl = capacity if capacity > 0 else CAPACITY, int((ttl if ttl > 0 else TTL) * MILLION)
        entries, self.hits, self.misses, self.evictions = held if held is not None else ([], 0, 0, 0)
        self.entries = OrderedDict((e[0], (e[1], e[2])) for e in entries)

    def ask(self, digest: str, who: str, now: int) -> tuple[bool, str, bool]:
        """Whether there is a hit, the row whose verdict answers, and whether another's verdict went."""
        entry = self.entries.get(digest)
        if entry is not None and now - entry[1] <= self.ttl:
            self.entries.move_to_end(digest)
            self.hits += 1
            return True, entry[0], False
        self.entries.pop(digest, None)
        self.misses += 1
        self.entries[digest] = (who, now)
        if len(self.entries) <= self.capacity:
            return False, who, False
        self.entries.popitem(last=False)
        self.evictions += 1
        return False, who, True

    def state(self) -> tuple:
        return [(k, *v) for k, v in self.entries.items()], self.hits, self.misses, self.evictions


def cached(stream: DataFrame, ts: str, who: str, text: str = "text", capacity: int = CAPACITY, ttl: float = TTL, shards: int = 1, late: str = "10 seconds") -> DataFrame:
    """stream (ts, who: a row's name, text) -> shard, micros, who, digest, hit, answered_by (the row whose scan answers: itself for a miss), evicted. Only rows without a hit need a scan. Texts are dealt over shards by digest; each shard is a cache of its own, so one shard is one cache for all."""

    def fold(held, rows):
        cache = Cache(capacity, ttl, held)
        out = [cache.ask(r[2], r[1], r[0]) for r in rows]
        return out, cache.state()

    rows = stream.withColumns({"_who": F.col(who).cast("string"), "_digest": F.sha2(F.coalesce(text, F.lit("")), 256)})
    rows = rows.withColumn("shard", F.pmod(F.crc32("_digest"), F.lit(shards)).cast("int")).select("shard", ts, F.col("_who").alias("who"), F.col("_digest").alias("digest"))
    return in_order(rows, "shard", ts, ["who", "digest"], "hit boolean, answered_by string, evicted boolean", fold, late, max(ttl, 1.0))


def cache_counts(answers: DataFrame, *by: str) -> DataFrame:
    """Answers of cached -> hits, misses and evictions, of all or by some of their columns."""
    return answers.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("evicted").alias("evictions"))


def replayed(rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], late: float, slices: int = 3) -> DataFrame:
    """A table as a stream: its rows in `slices` parts by time, each row up to half of `late` seconds out of order, arrive one part after the other, and a last row far ahead passes the watermark over all. Returns what the job has answered, as a table."""
    spark = rows.sparkSession
    place = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    span = rows.agg(F.min(ts).cast("double").alias("low"), F.max(ts).cast("double").alias("high")).head()
    low, width = span.low or 0.0, max((span.high or 0.0) - (span.low or 0.0), 1.0)
    at = F.col(ts).cast("double") + F.pmod(F.xxhash64(*rows.columns), F.lit(1000)) / 1000 * (late / 2) - F.lit(low)
    part = F.least(F.greatest(F.floor(at / (width + late) * slices), F.lit(0)), F.lit(slices - 1)).cast("int")
    dealt = rows.where(F.col(ts).isNotNull()).withColumn("_part", part)
    stored = f"{place}/parts"
    dealt.write.partitionBy("_part").parquet(stored)
    ahead = spark.range(1).select(*[(F.timestamp_seconds(F.lit(low + width + 3 * late + 10 * DAY)) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    ahead.write.parquet(f"{place}/ahead")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs
    for source in [*(f"{stored}/_part={i}" for i in range(slices)), f"{place}/ahead"]:
        path = where.Path(source)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            continue
        files.mkdirs(where.Path(f"{place}/in"))
        for f in files.listStatus(path):
            if f.getPath().getName().endswith(".parquet"):
                files.rename(f.getPath(), where.Path(f"{place}/in/{uuid.uuid4().hex}.parquet"))
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        job(stream).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    schema = job(spark.readStream.schema(rows.schema).parquet(f"{place}/in")).schema
    return spark.read.schema(schema).parquet(f"{place}/out")

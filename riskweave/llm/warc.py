"""WARC archives of captures, and an index of them in global order by URL key and time.

Each task writes its captures as WARC records, a gzip member each, into files of bounded size, and beside
each file a run: the file's captures sorted by URL key, time and id. Runs of many tasks are then merged
outside memory. A merge takes up to FAN runs and a range of keys, streams the runs' parts of that range
batch by batch and takes the least row again and again by a tree of losers: a new row climbs from its leaf
and meets at each step the loser that waits there. Its output is a segment of a longer run. Ranges are cut
by samples of the runs and hold about RANGE_ROWS rows, so a key with many captures is spread over several,
and each level has as many tasks as the rows ask for. Levels follow until one run is left, whose segments in
order are all captures in order; numbers in the whole order and in each URL's history come from the segments'
counts. No task and no machine holds more than a batch of each of FAN runs.

Of captures with equal payloads (by SHA-256 of their bytes) of at least `min_bytes`, that with the largest id
is the response and the others are revisits that name it; their records hold the HTTP head alone.

Cases: null bodies are empty. Rows without an id are revisits where an equal payload has an id, else responses;
rows that repeat the largest id of a payload are responses all. Null urls, and those without `://`, have their
whole text as key and an empty one where null; control characters and blanks in a url are percent-encoded in
the archive. Very large payloads make a file of their own. An empty table gives an empty archive and index.
Columns besides those named are not read. File names hold the attempt that wrote them, and only those that the
returned tables name count, so what lost attempts left does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored
from .token_files import filesystem

#: A file is closed after the record with which it reaches this many bytes, or this many records.
FILE_BYTES, FILE_ROWS = 64 << 20, 200_000
#: Runs that a merge reads at once; rows of a range; rows of a batch in a run; samples of a segment.
FAN, RANGE_ROWS, BATCH, SAMPLES = 64, 1_000_000, 2048, 8
#: Rows of a run, in order of KEY. A null id sorts before all others.
CAPTURE = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("has_id", pa.bool_()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
KEY = "struct<url_key:string, captured:string, has_id:boolean, id:bigint>"
SEGMENT = f"path string, n_rows long, first {KEY}, last {KEY}, tail long, samples array<{KEY}>"
_KEY_TYPE = pa.struct(list(CAPTURE)[:4])
#: Fixed: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """com,example)/path?query: host labels turned round, A-Z lower-cased; other texts as they are."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_extract(low, r"^[^/?#]*?://([^/?#]*)", 1)
    rest = F.regexp_extract(low, r"(?s)^[^/?#]*?://[^/?#]*(.*)$", 1)
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest)
    return F.when(low.rlike(r"^[^/?#]*://"), turned).otherwise(low)


def captures(pages: DataFrame, id_: str, url: str, body: str, captured: Column, min_bytes: int = 0) -> DataFrame:
    """pages -> id, url, url_key, captured, payload, refers_to (struct id, url, captured; null for responses)."""
    rows = pages.select(F.col(id_).cast("long").alias("id"), F.col(url).cast("string").alias("url"), url_key(F.col(url).cast("string")).alias("url_key"), F.coalesce(captured, F.lit("1970-01-01T00:00:00Z")).alias("captured"), F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    # one row for each payload that occurs again: counted in part before the shuffle
    again = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("id", "url", "captured")).alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to.id is not null").drop("n")
    revisit = F.col("refers_to").isNotNull() & F.coalesce(F.col("id") < F.col("refers_to.id"), F.col("id").isNull())
    return rows.join(again, "sha256", "left").select("id", "url", "url_key", "captured", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"))


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def name_of(id_: int | None) -> str:
    return f"<urn:capture:{id_}>" if id_ is not None else f"<urn:uuid:{uuid.uuid4()}>"


def capture_record(id_: int | None, url: str | None, captured: str, payload: bytes, refers: dict | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", name_of(id_)), ("WARC-Date", captured), ("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name_of(refers["id"])), ("WARC-Refers-To-Target-URI", None if refers["url"] is None else _uri(refers["url"])), ("WARC-Refers-To-Date", refers["captured"])]
    return record("revisit", fields, http)


def parsed(member: bytes) -> dict:
    """What a record says of its capture: id, type, digest, payload_bytes, refers_to, payload (null for revisits)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    response, sha1 = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(payload) != size or digest(payload) != sha1):
        raise ValueError("payload and digest differ")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:capture:(-?\d+)>", x)) else None
    return {"id": number(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "digest": sha1, "payload_bytes": size, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if response else None}


def _segment(where, path: str, batches: Iterator[list[tuple]]) -> tuple | None:
    """Writes sorted rows as a file; its row of SEGMENT, or None where there are no rows."""
    n, first, last, tail, samples, file, out = 0, None, None, 0, [], None, None
    every = 1
    for rows in batches:
        if not rows:
            continue
        if file is None:
            out = where.open_output_stream(path)
            file = pa.ipc.new_file(out, CAPTURE)
            first = rows[0][:4]
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), CAPTURE, strict=True)], schema=CAPTURE))
        for r in rows:
            if n % every == 0:
                samples.append(r[:4])
                if len(samples) == 2 * SAMPLES:  # every second one, and half as many from now on
                    samples, every = samples[::2], every * 2
            tail = tail + 1 if last is not None and last[0] == r[0] else 1
            last, n = r[:4], n + 1
    if file is None:
        return None
    file.close()
    out.close()
    return path, n, first, last, tail, samples


def _segment_batch(rows: list[tuple], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    named = lambda k: None if k is None else dict(zip(("url_key", "captured", "has_id", "id"), k, strict=True))
    path, n, first, last, tail, samples = zip(*rows, strict=True)
    columns = {"path": pa.array(path, pa.string()), "n_rows": pa.array(n, pa.int64()), "first": pa.array(map(named, first), _KEY_TYPE), "last": pa.array(map(named, last), _KEY_TYPE), "tail": pa.array(tail, pa.int64()), "samples": pa.array([list(map(named, s)) for s in samples], pa.list_(_KEY_TYPE))}
    return pa.RecordBatch.from_pydict(columns | (more or {}))


class _Archive:
    """The files of one attempt at a task."""

    def __init__(self, folder: str, file_bytes: int):
        self.where, self.folder = filesystem(folder)
        self.attempt, self.n, self.file_bytes, self.out, self.rows = uuid.uuid4().hex, 0, file_bytes, None, []

    def add(self, member: bytes, key: tuple) -> None:
        if self.out is None:
            self.name = f"captures-{self.attempt}-{self.n:04d}.warc.gz"
            self.out = self.where.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            info = record("warcinfo", [("WARC-Record-ID", name_of(None)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self.out.write(info)
            self.size = len(info)
        self.out.write(member)
        self.rows.append((*key, self.name, self.size, len(member)))
        self.size += len(member)

    def full(self) -> bool:
        return self.out is not None and (self.size >= self.file_bytes or len(self.rows) >= FILE_ROWS)

    def close(self) -> tuple:
        """The file's run."""
        self.out.close()
        out = _segment(self.where, f"{self.folder}/run-{self.attempt}-{self.n:04d}.arrow", iter([sorted(self.rows)]))
        self.out, self.rows, self.n = None, [], self.n + 1
        return out


def write_archive(found: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """captures -> the runs (a row of SEGMENT each) and the folder that holds files and runs."""
    folder = folder or f"{shared_dir(found.sparkSession)}/warc-{uuid.uuid4().hex}"
    where, path = filesystem(folder)
    where.create_dir(path, recursive=True)

    def write(batches):
        archive = _Archive(folder, file_bytes)
        for batch in slices(batches, "payload"):
            for r in batch.to_pylist():
                archive.add(capture_record(r["id"], r["url"], r["captured"], r["payload"], r["refers_to"]), (r["url_key"], r["captured"], r["id"] is not None, r["id"] or 0))
                if archive.full():
                    yield _segment_batch([archive.close()])
        if archive.out is not None:
            yield _segment_batch([archive.close()])

    return stored(found.mapInArrow(write, SEGMENT), "runs"), folder


class LoserTree:
    """The least of several sorted streams, again and again. Leaf i stands at place k + i of a heap; each inner place keeps the loser of its match, place 0 the winner."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams, self.k = streams, len(streams)
        self.heads = [next(s, None) for s in streams]
        winners = [0] * self.k + list(range(self.k))
        self.losers = [0] * max(self.k, 1)
        for i in range(self.k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.losers[i] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.streams[w], None)
            place = (self.k + w) // 2
            while place:
                if not self._before(w, self.losers[place]):
                    w, self.losers[place] = self.losers[place], w
                place //= 2
            self.losers[0] = w


def _stream(where, paths: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run's segments within [low, high); of a file the batches before are found by halving."""
    for path in paths:
        with where.open_input_file(path) as source:
            file = pa.ipc.open_file(source)
            lo, hi = 0, file.num_record_batches
            while low is not None and hi - lo > 1:
                mid = (lo + hi) // 2
                start = tuple(file.get_batch(mid).column(c)[0].as_py() for c in range(4))
                lo, hi = (mid, hi) if start <= low else (lo, mid)
            for i in range(lo, file.num_record_batches):
                for row in zip(*(c.to_pylist() for c in file.get_batch(i).columns), strict=True):
                    if high is not None and row[:4] >= high:
                        return
                    if low is None or row[:4] >= low:
                        yield row


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    yield held


def _level(runs: DataFrame, folder: str, fan: int, range_rows: int) -> DataFrame:
    """runs (run, SEGMENT) -> fewer runs of the same shape: each group of fan runs becomes one."""
    rows = runs.withColumn("group", F.floor(F.col("run") / fan))
    samples = rows.select("group", (F.col("n_rows") / F.size("samples")).alias("weight"), F.explode("samples").alias("key"))
    # SAMPLES to twice as many for each file of up to range_rows: a small part of the rows
    before = Window.partitionBy("group").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = samples.withColumn("at", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0.0)) / range_rows)).groupBy("group", "at").agg(F.min("key").alias("low"))
    own = Window.partitionBy("group").orderBy("at")
    ranges = cut.select("group", F.when(F.row_number().over(own) > 1, F.col("low")).alias("low"), F.lead("low").over(own).alias("high"))
    meets = (F.col("low").isNull() | (F.col("last") >= F.col("low"))) & (F.col("high").isNull() | (F.col("first") < F.col("high")))
    parts = ranges.join(rows.select("group", "run", "path", "first", "last"), "group").where(meets)
    by_run = parts.groupBy("group", "low", "high", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "path"))), lambda x: x.path).alias("paths"))
    tasks = stored(by_run.groupBy("group", "low", "high").agg(F.collect_list("paths").alias("runs")), "merges")

    def merge(batches):
        where, _ = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (None if r[k] is None else tuple(r[k].values()) for k in ("low", "high"))
                tree = LoserTree([_stream(where, paths, low, high) for paths in r["runs"]])
                if made := _segment(where, f"{filesystem(folder)[1]}/merged-{uuid.uuid4().hex}.arrow", _chunks(iter(tree), BATCH)):
                    yield _segment_batch([made], {"run": pa.array([r["group"]], pa.int64())})

    n = max(1, min(tasks.count(), 4 * tasks.sparkSession.sparkContext.defaultParallelism))
    return stored(tasks.repartition(n).mapInArrow(merge, f"{SEGMENT}, run long"), "level")


def merged_index(runs: DataFrame, folder: str, fan: int = FAN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """runs of write_archive -> all captures: url_key, captured, id, file, offset, length, place (in the whole order, from 1) and capture (in the URL's history, from 1)."""
    spark = runs.sparkSession
    # names of the runs are numbered without gaps in the runs' order of writing; one row a file of up to FILE_BYTES
    numbered = runs.withColumn("run", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    level = stored(numbered, "level")
    while True:
        level = _level(level, folder, fan, range_rows)
        if level.select("run").distinct().count() <= 1:
            break
        level = stored(level.withColumn("run", F.dense_rank().over(Window.orderBy("run")).cast("long") - 1), "level")
    order = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    segments = level.select("path", "n_rows", "first", "last", "tail", F.coalesce(F.sum("n_rows").over(order), F.lit(0)).alias("base"))
    # where the history of a segment's first key begins: in the first segment that ends with this key, or here
    begun = segments.groupBy(F.col("last.url_key").alias("_key")).agg(F.min(F.col("base") + F.col("n_rows") - F.col("tail")).alias("_begun"))
    segments = segments.join(begun, F.col("first.url_key") == F.col("_key"), "left").select("path", "base", F.least(F.coalesce("_begun", "base"), "base").alias("begun"))

    def read(batches):
        where, _ = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                place, key, begun_at = r["base"], None, r["begun"]
                for rows in _chunks(_stream(where, [r["path"]], None, None), BATCH):
                    if not rows:
                        continue
                    captures_, places = [], []
                    for x in rows:
                        if key is not None and x[0] != key:
                            begun_at = place
                        key, place = x[0], place + 1
                        places.append(place)
                        captures_.append(place - begun_at)
                    columns = dict(zip(CAPTURE.names, zip(*rows, strict=True), strict=True))
                    columns["id"] = [i if has else None for i, has in zip(columns["id"], columns.pop("has_id"), strict=True)]
                    yield pa.RecordBatch.from_pydict({**{k: pa.array(v, CAPTURE.field(k).type) for k, v in columns.items()}, "place": pa.array(places, pa.int64()), "capture": pa.array(captures_, pa.int64())})

    segments = stored(segments, "segments")
    n = max(1, min(segments.count(), 4 * spark.sparkContext.defaultParallelism))
    return stored(segments.repartition(n).mapInArrow(read, "url_key string, captured string, id long, file string, offset long, length long, place long, capture long"), "histories")


def read_archive(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """What the archive's records say, found by the index: url_key, captured, place, capture, id, type, digest, payload_bytes, refers_to (and payload). A response whose payload has another digest fails the read. Records of a file are read by one task, in order."""
    facts = ["id long", "type string", "digest string", "payload_bytes long", "refers_to long", *(["payload binary"] if payload else [])]

    def read(batches):
        where, path = filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows, held, size = [], [], 0
            for r in batch.select(["url_key", "captured", "place", "capture", "file", "offset", "length"]).to_pylist():
                if r["file"] != name:
                    name, source = r["file"], where.open_input_file(f"{path}/{r['file']}")
                source.seek(r["offset"])
                rows.append({**r, **parsed(source.read(r["length"]))})
                size += rows[-1]["payload_bytes"]
                if payload and size >= 1 << 22:
                    held, rows, size = rows, [], 0
                    yield _facts(held, schema)
            if rows:
                yield _facts(rows, schema)

    schema = f"url_key string, captured string, place long, capture long, {', '.join(facts)}"
    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def _facts(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in named], [k for k, _ in named])

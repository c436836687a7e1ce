"""URL filters by a Bloom filter cascade.

A list says block or allow for a host and all its subdomains, under a path prefix; the longest
entry that fits decides. A url's keys are its host suffixes with each path prefix whose length
occurs in the list. Over the complete universe of the corpus's keys, level 1 of a cascade encodes
the listed keys, level 2 the unlisted ones that level 1 takes for listed, level 3 the listed ones
that level 2 takes for those, and so on until no key is taken wrongly. From then on a look-up is
exact for every key of that universe: the first level that does not hold the key gives the answer,
and no join with the list is needed. What tells entries apart (block or allow, the length) is the
key itself and a cascade of its own for allowed entries.

Levels are bit arrays, built by a distributed aggregation of set bits. The first level is as fine
as the ratio of listed to all keys asks for, so that it takes about as many unlisted keys for
listed as there are listed ones: the cascade grows with the list, and with the universe only by
its logarithm. A list whose first level is over PART_BITS is dealt by a hash of the key into parts
with a cascade each, which are broadcast and looked up one after the other; no size is refused.
Keys are pairs of 64-bit hashes.

Cases: null entries of the list are left out; null urls and those without `://` have an empty host and path and no keys. With no entry
that fits the verdict is allow: the url is on no list. Repeated rows give repeated result rows; empty
tables give none. Very long urls have at most a key for each label of the host and each listed
length. Columns besides page_id and url are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, stored

#: Bits a key and hash functions of later levels: about 4 in 10 false positives.
LATER_BITS, LATER_HASHES = 2, 1
#: Bits of a part's first level: the bound of what is broadcast and of what the driver holds of it at once (twice over, for blocked and allowed entries).
PART_BITS = 1 << 27


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffix and path prefix of each listed length, as (host, path, key)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]), lambda p: p.isNotNull())
    return F.when(host == "", F.array().cast("array<struct<rule:string,size:int>>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("rule"), (F.length(s) + F.length(p)).alias("size"))))))


def hashed(rule: Column) -> tuple[Column, Column]:
    return F.xxhash64(rule), F.xxhash64(F.lit("second"), rule)


class Level:
    def __init__(self, bits: np.ndarray, m: int, k: int, seed: int):
        self.bits, self.m, self.k, self.seed = bits, m, k, seed

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in places(a, b, self.m, self.k, self.seed):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def places(a: np.ndarray, b: np.ndarray, m: int, k: int, seed: int) -> Iterator[np.ndarray]:
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    for i in range(k):
        yield (mixed(a + b * np.uint64(seed * 64 + i + 1)) % np.uint64(m)).astype(np.int64)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Listed: the number of levels that hold the key, from the first on, is odd."""
        going, depth = np.ones(len(a), bool), np.zeros(len(a), int)
        for level in self.levels:
            going &= level.holds(a, b)
            depth += going
        return depth % 2 == 1


def first_level(listed: int, universe: int) -> tuple[float, int]:
    """Bits a key and hash functions with which the first level takes about as many unlisted keys for listed as there are listed ones."""
    k = max(1, math.ceil(math.log2(max(universe, 1) / max(listed, 1))))
    return k / math.log(2), k


def _level(keys: DataFrame, n: int, depth: int, per: float, k: int) -> Level:
    """A Bloom filter of the keys (a, b): each task sets its bits, words of 32 are joined by bit_or."""
    m = max(64, math.ceil(per * n))

    def set_bits(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            at = np.unique(np.concatenate(list(places(a, b, m, k, depth))))
            slot, start = np.unique(at >> 5, return_index=True)
            word = np.bitwise_or.reduceat(np.int64(1) << (at & 31), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word)], ["slot", "word"])

    words = np.zeros(-(-m // 32), "<u4")
    found = keys.mapInArrow(set_bits, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()  # a row for 32 bits at most
    words[found.column("slot").to_numpy()] = found.column("word").to_numpy()
    return Level(words.view(np.uint8), m, k, depth)


def _taken(level):
    """The keys that a level holds."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(level.value.holds(*(batch.column(c).to_numpy() for c in ("a", "b")))))

    return run


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed and universe: distinct keys (a, b); universe holds every key that will be looked up."""
    sc = listed.sparkSession.sparkContext
    inside = stored(listed.select("a", "b").distinct(), "listed")
    outside = stored(universe.select("a", "b").join(inside, ["a", "b"], "left_anti").distinct(), "unlisted")
    levels: list[Level] = []
    n = inside.count()
    first = first_level(n, n + outside.count())
    while n:
        level = _level(inside, n, len(levels), *(first if not levels else (LATER_BITS, LATER_HASHES)))
        levels.append(level)
        wrong = stored(outside.mapInArrow(_taken(sc.broadcast(level)), "a long, b long"), "wrong")
        discard(outside)
        inside, outside, n = wrong, inside, wrong.count()
    discard(inside, outside)
    return Cascade(levels)


def _looked_up(made, part: int, parts: int):
    """The keys of a part get their kind (2 blocked, 1 allowed, 0 neither); those of other parts keep theirs."""

    def run(batches):
        blocks, allows = made.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = batch.slice(i, 4096)
                keys, held = rows.column("hashes"), rows.column("kinds").flatten().to_numpy()
                flat = keys.flatten()
                a, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
                kind = np.where(blocks.holds(a, b), 2, np.where(allows.holds(a, b), 1, 0))
                kind = pa.array(np.where(b % parts == part, kind, held).astype(np.int32))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("page_id", "host", "path", "keys", "hashes")), pa.ListArray.from_arrays(pa.array(ends), kind)], ["page_id", "host", "path", "keys", "hashes", "kinds"])

    return run


def judged(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], part_bits: int = PART_BITS) -> DataFrame:
    """pages (page_id, url), rules (verdict, host, path), a table or a list -> page_id, host, path, rule, verdict. An entry listed as both is blocked."""
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    entries = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("length")).where("rule is not null")
    lengths = sorted(r.length for r in entries.select("length").distinct().collect())  # as many as the longest listed path has characters, at most
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths or [0]))
    rows = stored(rows, "pages")
    a, b = hashed(F.col("rule"))
    universe = stored(rows.select("keys").distinct().select(F.inline("keys")).select(a.alias("a"), b.alias("b")).distinct(), "universe")
    blocked = entries.where("verdict = 'block'").select("rule").distinct()
    allowed = entries.where("verdict = 'allow'").select("rule").distinct().join(blocked, "rule", "left_anti")
    lists = [stored(x.select(a.alias("a"), b.alias("b")), "list") for x in (blocked, allowed)]
    per, _ = first_level(1, universe.count())
    parts = max(1, *(math.ceil(per * x.count() / part_bits) for x in lists))

    id_type = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, host string, path string, keys array<struct<rule:string,size:int>>, hashes array<struct<a:bigint,b:bigint>>, kinds array<int>"
    hashes = F.transform("keys", lambda k: F.struct(hashed(k.rule)[0].alias("a"), hashed(k.rule)[1].alias("b")))
    found = rows.withColumns({"hashes": hashes, "kinds": F.transform("keys", lambda k: F.lit(0))})
    for part in range(parts):
        mine = F.pmod("b", F.lit(parts)) == part
        made = spark.sparkContext.broadcast([cascade(x.where(mine), universe.where(mine)) for x in lists])
        found = found.mapInArrow(_looked_up(made, part, parts), schema)
        if part + 1 < parts:  # so that one part's cascades are in use at a time
            held, found = found, stored(found, "judged")
            made.destroy()
            discard(held)
    discard(universe, *lists)
    fits = F.filter(F.zip_with("keys", "kinds", lambda k, v: F.struct(k["size"].alias("size"), k.rule.alias("rule"), v.alias("kind"))), lambda k: k.kind > 0)
    best = F.array_max(fits)
    return found.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.kind") == 2, "block").otherwise("allow").alias("verdict"))

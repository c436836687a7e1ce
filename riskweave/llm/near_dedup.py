"""Near-duplicate documents by one-permutation MinHash, banded buckets and star edges.

A document's set holds the hashes of its distinct 5-word shingles (A-Z lower-cased; words are
runs of anything but space and tab to carriage return). One hash pass deals the set's members
over bins; the least member of each bin is its signature, and empty bins borrow from a filled
one along a fixed random order of their own (optimal densification). Bands of bins are buckets.

Equal sets are first folded into classes. In each bucket of classes, a star joins a centre to all
members; sizes and bitmaps of the sets rule out most unlike pairs, full sets confirm the others, and
linked classes become components. Then only buckets that still hold different components go on.

Buckets that stay mixed hold texts with passages in common that are not near copies. Their members
are dealt anew by a second, longer signature of other hashes and by wider bands: two sets at the
threshold have one in common in all but 2 of a million cases, while of two that share half or less of
their union few ever meet, so the pairs to judge are few even where all texts share passages.

From then on a bucket has many centres at a time, none of them from its largest component. A group of
near copies is one component after the first stars, all but a few, so what is left to find are links
between components. First only the likeliest pair of each two components (the one whose bitmaps differ
least) is confirmed, for all buckets together; that joins most of them. Then the centres meet whatever
else is not ruled out and still lies in another component, and leave their buckets. This ends when
every pair of a bucket has been ruled out, compared, or lies in one component: no link between two
members of a bucket is lost, while a group of n copies costs about n edges, not n squared. Centres are
copied to parts of a large bucket, so its members are spread over tasks.

Cases: null, empty or blank texts have an empty set, link with nothing and are kept. Rows without
doc_id link like others; they are kept only where no row of their component has an id, and component_id
is null there. Rows that repeat a doc_id are documents of their own, each with its text's component;
equal rows give equal result rows. Very long texts are taken whole. An empty table gives an empty
result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, discard, grams, mixed, slices, stored, text_bytes

WORDS, PERCENT = 5, 75
#: 32 bands of 4 bins: of pairs at 0.75, about 5 in a million share no bucket.
BANDS, ROWS = 32, 4
#: Centres of a bucket in the first rounds and in later ones; the round before which mixed buckets are dealt anew.
FIRST, LATER, REFINED = 1, 256, 1
#: Bands and rows by which mixed buckets are dealt anew, and what their hashes are mixed with.
SHARP_BANDS, SHARP_ROWS, SHARP_MIX = 128, 8, np.uint64(0x9FB21C651E98DF25)
#: Members of a bucket's part, and pairs that a task judges at once.
PART, PAIRS = 4096, 1 << 17
#: Bits of the filter that spares most texts without a partner the shuffle; it only lets too many pass when it is full.
FILTER_BITS = 1 << 26
#: Bits of the bitmap of a set that spares most unlike pairs the comparison of full sets, and of the small one that members of buckets carry.
BITMAP, SMALL = 2048, 1024

#: Columns of a member of a bucket.
MEMBER = ["key", "rep", "n"]


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    return np.unique(grams(hashes.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


@lru_cache(2)
def _probes(bins: int) -> np.ndarray:
    """Row i: the order in which bin i, when empty, looks for a filled one."""
    return np.argsort(np.random.default_rng(20240229).random((bins, bins)), axis=1)


def signature(members: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Least member of each bin (a power of 2 of them), empty bins densified. members: sorted, so the first of a bin is its least."""
    filled, first = np.unique((members >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64), return_index=True)
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[filled], full[filled] = members[first], True
    if len(filled) < bins:
        empty = np.flatnonzero(~full)
        probes = _probes(bins)[empty]
        out[empty] = out[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.array([xxhash.xxh3_64_intdigest(part.tobytes(), seed=i) for i, part in enumerate(sig.reshape(bands, -1))], np.uint64)
    return keys.view(np.int64)


def sharp_keys(members: np.ndarray) -> np.ndarray:
    """Keys of the second signature."""
    return band_keys(signature(np.sort(mixed(members ^ SHARP_MIX)), SHARP_BANDS * SHARP_ROWS), SHARP_BANDS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        n, digest, bands = [], [], []
        for text in text_bytes(batch.column("text")):
            members = shingle_set((text or b"").lower().split(), hashes)
            n.append(len(members))
            digest.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
            bands.append(band_keys(signature(members)) if len(members) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "digest", "bands"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges, those whose full sets have the similarity."""
    hashes, last, centre = WordHashes(), None, None
    for batch in slices(batches, "x_text"):
        a, b = batch.column("c").to_pylist(), batch.column("x").to_pylist()
        keep = []
        for c, ct, xt in zip(a, text_bytes(batch.column("c_text")), text_bytes(batch.column("x_text")), strict=True):
            if c != last:
                last, centre = c, shingle_set(ct.lower().split(), hashes)
            other = shingle_set(xt.lower().split(), hashes)
            both = len(np.intersect1d(centre, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(centre) + len(other) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c", "x"]).filter(pa.array(keep, pa.bool_()))


def _rank(column: str) -> Column:
    """A random order of ids, the same in all rounds."""
    return F.xxhash64(F.lit("rank"), column)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after joining the components that links (c, x) connect. Each turn every component hooks to the least of itself and its neighbours in a random order, and the edges contract; components without a link are not touched."""
    of = lambda side: labels.select(F.col("rep").alias(side), F.col("comp").alias(f"{side}_comp"))
    edges = stored(links.join(of("c"), "c").join(of("x"), "x").where("c_comp <> x_comp").select(F.col("c_comp").alias("a"), F.col("x_comp").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        discard(edges)
        return labels
    moved = None  # component -> where it has gone
    while not edges.isEmpty():
        ranked = lambda side: F.struct(_rank(side).alias("h"), F.col(side).alias("v"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select("a", F.least("m", ranked("a")).getField("v").alias("to"))
        hook = stored(hook, "hook")
        shrunk = edges.join(hook.select("a", F.col("to").alias("a_to")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        shrunk = stored(shrunk, "edges")
        discard(edges)
        if moved is None:
            moved = hook.withColumnRenamed("a", "comp")
            moved._stored_path = hook._stored_path
        else:
            fresh = stored(moved.join(hook.select(F.col("a").alias("to"), F.col("to").alias("on")), "to", "left").select("comp", F.coalesce("on", "to").alias("to")), "moved")
            discard(moved, hook)
            moved = fresh
        edges = shrunk
    fresh = stored(labels.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "labels")
    discard(labels, edges, moved)
    return fresh


def _judged(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by bucket and part, centres first -> pairs (c, x) of a centre and a member of another component that are not ruled out, with their components (a < b) and the bits in which they differ. Not every: of each two components the pair that differs least."""

    def run(batches):
        carried = None
        for batch in batches:
            own = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "part", "is_centre", "rep", "n", "comp")}
            own["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, SMALL // 64)
            if carried is not None:
                own = {k: np.concatenate([carried[k], v]) for k, v in own.items()}
            fresh = np.ones(len(own["key"]), bool)  # begins a part of a bucket
            fresh[1:] = (own["key"][1:] != own["key"][:-1]) | (own["part"][1:] != own["part"][:-1])
            starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            centres = np.bincount(group, own["is_centre"], len(starts)).astype(np.int64)
            last = slice(starts[-1], starts[-1] + centres[-1])
            rows = np.flatnonzero(~own["is_centre"])
            held = np.cumsum(centres[group[rows]])
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(held, (held[i - 1] if i else 0) + PAIRS, "right")))
                yield _fitting(own, rows[i:j], starts[group[rows[i:j]]], centres[group[rows[i:j]]], every)
                i = j
            carried = {k: v[last].copy() for k, v in own.items()}

    return run


def _fitting(own: dict[str, np.ndarray], rows: np.ndarray, first: np.ndarray, count: np.ndarray, every: bool) -> pa.RecordBatch:
    """Each of these rows with the `count` centres from place `first` on."""
    x = np.repeat(rows, count)
    c = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(x))
    n, comp, rep = (own[k] for k in ("n", "comp", "rep"))
    ok = (comp[c] != comp[x]) & (100 * np.minimum(n[c], n[x]) >= PERCENT * np.maximum(n[c], n[x]))
    c, x = c[ok], x[ok]
    differ = np.bitwise_count(own["bits"][c] ^ own["bits"][x]).sum(axis=1, dtype=np.int64)
    ok = _near(differ, n[c] + n[x])
    c, x, differ = c[ok], x[ok], differ[ok]
    a, b = np.minimum(comp[c], comp[x]), np.maximum(comp[c], comp[x])
    if not every:
        order = np.lexsort((differ, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        best = order[new]
        c, x, differ, a, b = c[best], x[best], differ[best], a[best], b[best]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (rep[c], rep[x], a, b, differ)], ["c", "x", "a", "b", "differ"])


def _sharp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sets = [shingle_set(t.lower().split(), hashes) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(sharp_keys, sets)), pa.list_(pa.int64()))], ["rep", "n", "keys"])


def _refined(live: DataFrame, texts: DataFrame) -> DataFrame:
    """members (key, rep, n) of new buckets: those of the second signature's bands that more than one text has."""
    reps = live.select("rep").distinct()
    keys = stored(texts.join(reps, "rep", "left_semi").mapInArrow(_sharp, "rep long, n long, keys array<long>"), "keys")
    rows = keys.select("rep", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key")
    out = stored(rows.join(shared, "key").select(*MEMBER), "members")
    discard(keys)
    return out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: the set's size, and a large and a small bitmap with the bit of each member set."""
    hashes = WordHashes()
    for batch in slices(batches):
        sets = [shingle_set(t.lower().split(), hashes) for t in text_bytes(batch.column("text"))]
        maps = np.zeros((len(sets), BITMAP), bool)
        for row, members in zip(maps, sets, strict=True):
            row[(members % np.uint64(BITMAP)).astype(np.int64)] = True
        small = maps.reshape(len(sets), -1, SMALL).any(axis=1)
        large = pa.array(list(np.packbits(maps, axis=1).view(np.int64)), pa.list_(pa.int64()))
        small = pa.array([x.tobytes() for x in np.packbits(small, axis=1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(map(len, sets)), pa.int64()), large, small], ["rep", "n", "bits", "small"])


def _near(differ, n):
    """Whether bitmaps that differ in so many bits allow for the similarity of sets with n members together, an exact filter: each such bit shows a member that only one of the sets has."""
    return (100 + PERCENT) * differ <= (100 - PERCENT) * n


def _likely(edges: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Of the edges (c, x), those whose large bitmaps allow for the similarity."""
    of = lambda side: bitmaps.select(F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
    differ = F.aggregate(F.zip_with("c_bits", "x_bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return edges.join(of("c"), "c").join(of("x"), "x").where(_near(differ, F.col("c_n") + F.col("x_n"))).select("c", "x")


def _filter_bits(ids: np.ndarray) -> list[np.ndarray]:
    x = mixed(ids.view(np.uint64))
    return [(x >> np.uint64(s) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (0, 28)]


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_filter_bits(batch.column("at").to_numpy())))
        slot, start = np.unique(at >> 5, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), start) if len(at) else at)], ["slot", "word"])


def _marked(docs: DataFrame) -> DataFrame:
    """docs with a mark of the text; doc_id and mark together name a row's content."""
    return docs.withColumn("mark", F.xxhash64("text"))


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of reps (rep, doc_id, mark), a row each. A Bloom filter of bounded size keeps most other texts out of the shuffle of the exact join."""
    words = np.zeros(FILTER_BITS // 32, "<u4")
    at = F.xxhash64("doc_id", "mark").alias("at")
    # FILTER_BITS / 32 rows at most, in one job
    found = reps.select(at).mapInArrow(_set_bits, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    words[found.column("slot").to_numpy()] = found.column("word").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(words)

    def likely(batches):
        for batch in batches:
            ids = batch.column("at").to_numpy()
            yield batch.filter(pa.array(np.logical_and.reduce([held.value[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1 for at in _filter_bits(ids)])))

    marked = _marked(docs).select("doc_id", "mark", "text", at)
    some = marked.mapInArrow(likely, marked.schema)
    wanted = reps.select("rep", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return stored(some.join(wanted, same).select("rep", "text").dropDuplicates(["rep"]), "texts")


def _live(members: DataFrame, labels: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with component and small bitmap, the bucket's parts, and whether they can be centres: not those of its largest component."""
    here = members.join(labels, "rep").join(bitmaps.select("rep", F.col("small").alias("bits")), "rep")
    buckets = here.groupBy("key", "comp").agg(F.count("*").alias("held"))
    buckets = buckets.groupBy("key").agg(F.sum("held").alias("held"), F.count("*").alias("comps"), F.max(F.struct("held", "comp")).getField("comp").alias("largest"))
    buckets = buckets.where("comps > 1").select("key", "largest", F.ceil(F.col("held") / PART).cast("int").alias("parts"))
    return stored(here.join(buckets, "key").select(*MEMBER, "comp", "bits", "parts", (F.col("comp") != F.col("largest")).alias("small_comp")), "live")


def _pairs(live: DataFrame, centres: DataFrame, every: bool) -> DataFrame:
    """The pairs of centres and members, see _judged; a centre meets each part of its bucket."""
    columns = ["key", "part", "is_centre", "rep", "n", "comp", "bits"]
    met = live.select("*", F.pmod(F.xxhash64(F.lit("part"), "rep"), "parts").cast("int").alias("part"), F.lit(False).alias("is_centre"))
    copies = centres.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_centre"))
    rows = met.select(*columns).unionByName(copies.select(*columns)).repartition("key", "part").sortWithinPartitions("key", "part", F.desc("is_centre"))
    pairs = rows.mapInArrow(_judged(every), "c long, x long, a long, b long, differ long")
    if every:  # a pair met in several buckets, or of two centres, is compared once
        return pairs.groupBy(F.least("c", "x").alias("c"), F.greatest("c", "x").alias("x")).agg(F.min("differ").alias("differ")).select("c", "x")
    return pairs.groupBy("a", "b").agg(F.min(F.struct("differ", "c", "x")).alias("p")).select("p.c", "p.x")


def _joined(labels: DataFrame, pairs: DataFrame, bitmaps: DataFrame, texts: DataFrame) -> DataFrame:
    """labels after confirming the pairs by their full sets."""
    of = lambda side: texts.select(F.col("rep").alias(side), F.col("text").alias(f"{side}_text"))
    both = _likely(pairs, bitmaps).join(of("x"), "x").join(of("c"), "c")
    links = stored(both.select("c", "x", "c_text", "x_text").mapInArrow(_confirmed, "c long, x long"), "links")
    labels = _merged(labels, links)
    discard(links)
    return labels


def near_duplicates(docs: DataFrame, detailed: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (least id reachable), kept. Detailed: also mark (xxhash64 of the text) and component (a number of the group, also where ids do not tell groups apart; null for empty sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(_marked(docs).mapInArrow(_signed, "doc_id long, mark long, n long, digest binary, bands array<long>"), "signed")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # ids are fixed by writing the table
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "row.doc_id", "row.mark", "n", "bands"), "classes")
    bands = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = stored(bands.join(shared, "key").select(*MEMBER), "members")
    labels = stored(members.select("rep").distinct().select("rep", F.col("rep").alias("comp")), "labels")
    texts = _texts(docs, classes.join(labels, "rep", "left_semi").select("rep", "doc_id", "mark"))
    bitmaps = stored(texts.mapInArrow(_bitmaps, "rep long, n long, bits array<long>, small binary"), "bitmaps")
    turn = 0
    while True:
        live = _live(members, labels, bitmaps)
        if live.isEmpty():
            discard(live)
            break
        if turn == REFINED:
            fresh = _refined(live, texts)
            discard(members, live)
            members, turn = fresh, turn + 1
            continue
        first = Window.partitionBy("key").orderBy(_rank("rep"), "rep")
        centres = stored(live.where("small_comp").withColumn("place", F.row_number().over(first)).where(F.col("place") <= (LATER if turn else FIRST)).drop("place"), "centres")
        if turn:
            labels = _joined(labels, _pairs(live, centres, False), bitmaps, texts)
            now = lambda rows: rows.drop("comp").join(labels, "rep")
            labels = _joined(labels, _pairs(now(live), now(centres), True), bitmaps, texts)
        else:
            labels = _joined(labels, _pairs(live, centres, True), bitmaps, texts)
        rest = stored(live.join(centres.select("key", "rep"), ["key", "rep"], "left_anti").select(*MEMBER), "members")
        discard(members, live, centres)
        members, turn = rest, turn + 1
    discard(members, texts, bitmaps)
    least = labels.join(classes.select("rep", "doc_id"), "rep").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    joined = classes.join(labels, "rep", "left").join(least, "comp", "left").select("digest", F.coalesce("comp", "rep").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = stored(joined, "joined")
    out = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "digest").join(joined, "digest", "left")
    least_id = F.coalesce("component_id", "doc_id")
    more = ["mark", "component"] if detailed else []
    return out.select("doc_id", "n_shingles", least_id.alias("component_id"), (least_id.isNull() | F.col("doc_id").eqNullSafe(least_id)).alias("kept"), *more)

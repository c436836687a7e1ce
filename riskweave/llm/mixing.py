"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (one value of each dimension: source, language, topic). Raking scales the
cells' weights to the target share of each value of each dimension in turn, until all marginals
agree. Calibrated weights then give each document of a cell one inclusion probability, with which
it is sampled by a hash of its id; where a cell would be needed more often than it exists, its
probability is 1 and the rest of its weight is reported per document. Raking ends when no marginal
is further from its target than TOLERANCE, or after TURNS; `gap` tells the largest difference that
the last turn met, so that marginals which cannot agree show.

The cell table is an aggregation, far smaller than the documents. Up to LOCAL cells one task rakes it;
a larger table stays distributed, joined with sums of itself and written to the shared folder between turns.

Cases: null values of a dimension are a value of their own; null texts have no tokens and enter
with weight 0 and probability 0; an empty table gives an empty result, long texts count whole, and
other columns are dropped, whatever their names, but for those to carry. Sampling depends on the seed,
doc_id and text, so repeated rows with an id stay or go together, and texts under one id each for itself;
rows without an id are drawn by their place in the stored table, each for itself, equal ones too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

TURNS, TOLERANCE = 30, 1e-4
#: Cells that one task rakes: some 20 MB.
LOCAL = 100_000
#: Targets flatten what is there: a value's share goes with its tokens to this power.
POWER = 0.5
#: Tokens to draw, as a share of all.
DRAW = 0.5
DIMENSIONS = ("source", "lang", "topic")
#: A value that stands for null in keys.
_NONE = "\x00null"


def n_words(text: Column) -> Column:
    """Words of the text: runs of anything but space and tab to carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse subject from the text's whole shape, where no topic column is there: code-like, listing, long or short prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    odd = F.length(text) - F.length(F.translate(text, "{}[]()=<>|;$#&*%", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return F.when(50 * odd > size, "markup").when(size < 60 * lines, "listing").when(size >= 4000, "long prose").otherwise("short prose")


def flattened(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """A target marginal: (value, share) with shares as tokens to the power."""
    by = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part"))
    whole = by.agg(F.sum("part").alias("whole")).head()[0]
    return by.select("value", (F.col("part") / F.lit(float(whole or 1))).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], turns: int = TURNS, tolerance: float = TOLERANCE, local: int = LOCAL) -> DataFrame:
    """cells (dimensions, tokens > 0) -> with weight, whose marginals are the targets', and gap. A target value that no cell has is left out, and so is a cell whose value no target has (weight 0). Up to `local` cells are raked in one task, more by joins; the weights are the same."""
    cells = stored(cells, "cells")
    if cells.count() <= local:
        return _raked_in_one(cells, targets, turns, tolerance)
    return _raked_by_joins(cells, targets, turns, tolerance)


def _raked_in_one(cells: DataFrame, targets: dict[str, DataFrame], turns: int, tolerance: float) -> DataFrame:
    # values that these cells have: no more than there are cells
    wanted = [{r.value: r.share for r in t.join(cells.select(F.col(d).alias("value")).distinct(), "value", "left_semi").collect()} for d, t in targets.items()]
    names = list(targets)

    def rake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        weight, gap = table.column("tokens").to_numpy().astype(float), 0.0
        sides = []
        for d, shares in zip(names, wanted, strict=True):
            coded = table.column(d).combine_chunks().dictionary_encode()
            sides.append((coded.indices.to_numpy(), np.array([shares.get(v, 0.0) for v in coded.dictionary.to_pylist()])))
        for _ in range(turns):
            off = np.zeros(len(weight))
            for at, share in sides:
                held = np.bincount(at, weight, len(share))
                off = np.maximum(off, np.abs(share - held)[at])
                weight = weight * np.where(held > 0, share / np.where(held > 0, held, 1.0), 0.0)[at]
            gap = float(off.max())
            if gap < tolerance:
                break
        yield pa.RecordBatch.from_arrays([*(table.column(d).combine_chunks() for d in DIMENSIONS), table.column("tokens").combine_chunks(), pa.array(weight), pa.array(np.full(len(weight), gap))], [*DIMENSIONS, "tokens", "weight", "gap"])

    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", tokens long, weight double, gap double"
    return stored(cells.select(*DIMENSIONS, "tokens").coalesce(1).mapInArrow(rake, schema), "cells")


def _raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], turns: int, tolerance: float) -> DataFrame:
    cells = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    targets = {d: stored(t, "target") for d, t in targets.items()}
    worst = None
    for _ in range(turns):
        now = cells.withColumn("off", F.lit(0.0))
        for d, target in targets.items():
            share = F.coalesce("share", F.lit(0.0))
            sums = now.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("held")).join(target, "value", "left")
            factor = sums.select(F.col("value").alias(d), F.when(F.col("held") > 0, share / F.col("held")).otherwise(0.0).alias("factor"), F.abs(share - F.col("held")).alias("gap"))
            now = now.join(factor, d).select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"), F.greatest("off", "gap").alias("off"))
        fresh = stored(now, "cells")
        worst = fresh.agg(F.max("off")).head()[0]
        discard(cells)
        cells = fresh.drop("off")
        cells._stored_path = fresh._stored_path
        if worst is None or worst < tolerance:
            break
    discard(*targets.values())
    return cells.withColumn("gap", F.lit(worst).cast("double"))


def _scale(cells: DataFrame, draw: float) -> float:
    """The scale at which probabilities min(1, scale * weight / tokens) draw that share of all tokens: bisection, each step one small aggregate of the cells."""
    total = cells.agg(F.sum("tokens")).head()[0] or 0
    most = cells.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).head()[0]
    if not total or most is None:
        return 0.0
    low, high = 0.0, float(most)
    grid = 16
    for _ in range(6):  # 16 points a pass: the interval shrinks by 16 to the sixth
        points = [low + (high - low) * (i + 1) / grid for i in range(grid)]
        got = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * p)).alias(f"g{i}") for i, p in enumerate(points)]).head()
        i = next((i for i in range(grid) if got[i] >= draw * total), grid - 1)
        low, high = (points[i - 1] if i else low), points[i]
    return high


def drawn_at(seed: Column) -> Column:
    """A number from 0 to 1 for each row of mixed_sample's table, even over rows that no id tells apart."""
    named = F.when(F.col("doc_id").isNull(), F.xxhash64(seed, F.lit("row"), F.col("_row"))).otherwise(F.xxhash64(seed, F.col("doc_id"), F.col("_mark")))
    return named.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def mixed_sample(docs: DataFrame, draw: float = DRAW, power: float = POWER, seed: int = 7, targets: dict[str, DataFrame] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text, source, lang, perhaps topic) -> doc_id, source, lang, topic, n_words, probability, sampled, weight (of a sampled document, for weighted sums to meet the marginals exactly in expectation), gap (one number for all rows; null without tokens). Targets: (value, share) by dimension; else flattened from the tokens that are there. With carry also those columns of docs, and _row and _mark, by which drawn_at draws."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"))
    extra = [c for c in carry if c not in ("doc_id", *DIMENSIONS)]
    # the number is fixed by writing the table
    own = [F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.col("text").cast("string")).alias("_mark")]
    named = docs.select("doc_id", *own, *extra, *[F.coalesce(F.col(c).cast("string"), F.lit(_NONE)).alias(c) for c in ("source", "lang")], F.coalesce(topic, F.lit(_NONE)).alias("topic"), n_words(F.col("text")).alias("n_words"))
    counted = stored(named, "counted")
    cells = stored(counted.groupBy(*DIMENSIONS).agg(F.sum("n_words").alias("tokens")).where("tokens > 0"), "cells")
    fitted = raked(cells, targets or {d: flattened(cells, d, power) for d in DIMENSIONS})
    scale = _scale(fitted, draw)
    wanted = (F.col("weight") * F.lit(scale) / F.col("tokens")).alias("wanted")
    gap = fitted.select("gap").head()
    out = counted.join(fitted.select(*DIMENSIONS, wanted), list(DIMENSIONS), "left")
    chance = F.when(F.col("n_words") > 0, F.coalesce(F.least(F.col("wanted"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    null_back = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    return out.select("doc_id", *map(null_back, DIMENSIONS), "n_words", chance.alias("probability"), (drawn_at(F.lit(seed)) < chance).alias("sampled"), F.coalesce(F.when(chance > 0, F.col("wanted") / chance), F.lit(0.0)).alias("weight"), F.lit(gap and gap[0]).cast("double").alias("gap"), *([*extra, "_row", "_mark"] if carry else []))

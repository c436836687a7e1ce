"""The embedding second opinion: centroids, cosine pre-filter, linear head. Vectors are array columns of one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BENIGN_FROM = 0.35


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and for vectors of different lengths."""
    return F.when((F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    return F.when(norm(a) < 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def pooled(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, element by element."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    return F.transform(F.sequence(F.lit(0), F.size(vectors[0]) - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + v[i]) / F.greatest(F.size(kept), F.lit(1)))


def centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows (label, embedding) -> label, centroid: the mean, L2-normalised. Sums are taken by place, map-side first."""
    by = rows.select(label, F.posexplode("embedding").alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = by.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))
    return mean.select(label, unit(F.col("centroid")).alias("centroid"))


def prefilter(rows: DataFrame, tp: list[float], tn: list[float], benign_from: float = BENIGN_FROM) -> DataFrame:
    """rows with embedding -> with margin and verdict (likely_benign, unknown)."""
    a, b = (F.array(*map(F.lit, v)) for v in (tp, tn))
    margin = F.round(cosine(F.col("embedding"), b) - cosine(F.col("embedding"), a), 6)
    return rows.withColumn("margin", margin).withColumn("verdict", F.when((F.size("embedding") == len(tp)) & (F.col("margin") >= benign_from), "likely_benign").otherwise("unknown"))


def linear_head(rows: DataFrame, positive: Column, label: str = "label") -> DataFrame:
    """rows (embedding) with a test for positives -> one row: weights (unit difference of centroids), bias, tp_right, tn_right."""
    named = rows.select(positive.cast("int").alias("side"), "embedding")
    c = centroids(named, "side")
    both = c.agg(F.max(F.when(F.col("side") == 1, F.col("centroid"))).alias("tp"), F.max(F.when(F.col("side") == 0, F.col("centroid"))).alias("tn"))
    w = both.select(unit(F.zip_with("tp", "tn", lambda a, b: a - b)).alias("weights"))
    proj = named.crossJoin(F.broadcast(w)).select("side", "weights", dot(F.col("embedding"), F.col("weights")).alias("p"))
    bias = proj.agg((-(F.avg(F.when(F.col("side") == 1, F.col("p"))) + F.avg(F.when(F.col("side") == 0, F.col("p")))) / 2).alias("bias"))
    fit = proj.crossJoin(F.broadcast(bias)).agg(F.first("weights").alias("weights"), F.first("bias").alias("bias"), F.count_if((F.col("side") == 1) & (F.col("p") + F.col("bias") > 0)).alias("tp_right"), F.count_if((F.col("side") == 0) & (F.col("p") + F.col("bias") <= 0)).alias("tn_right"))
    return fit


def head_score(embedding: Column, weights: Column, bias: Column) -> Column:
    """In [-1, 1]."""
    return F.tanh(dot(embedding, weights) + bias)

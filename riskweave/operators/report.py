"""Accuracy reports: confusion counts, rates, misses by pattern, regression against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits on rates, and tolerances against a baseline.
BUDGET = {"fp_rate": 0.05, "fn_rate": 0.03, "category_fn_rate": 0.10}
RECALL_DROP, FP_RISE = 0.02, 0.01


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 9))


def _counts() -> list[Column]:
    truth, said = F.col("expected"), F.col("blocked")
    return [F.count_if(c).alias(n) for n, c in (("tp", truth & said), ("fn", truth & ~said), ("fp", ~truth & said), ("tn", ~truth & ~said))]


def _rates(df: DataFrame) -> DataFrame:
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fp_rate": ratio(fp, fp + tn), "fn_rate": ratio(fn, tp + fn)})
    return df.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("total", tp + fn + fp + tn)


def accuracy(samples: DataFrame) -> DataFrame:
    """samples (expected, blocked) -> one row of counts and rates."""
    return _rates(samples.agg(*_counts()))


def accuracy_by(samples: DataFrame, category: str) -> DataFrame:
    """Overall (category null, level 1) and by category in one pass."""
    return _rates(samples.groupingSets([[], [F.col(category)]], F.col(category)).agg(F.grouping(category).cast("int").alias("overall"), *_counts()))


def false_positives(samples: DataFrame, examples: int = 5) -> DataFrame:
    """samples (sample_id, expected, blocked, pattern_name) -> pattern, fp_count, total_negatives, fp_rate (over all negatives), example_ids (the least), by falling count."""
    rows = samples.withColumn("_pattern", F.coalesce("pattern_name", F.lit("")))
    wrong = ~F.col("expected") & F.col("blocked")
    whole = samples.agg(F.count_if(~F.col("expected")).alias("total_negatives"))  # one row
    counts = rows.where(wrong).groupBy("_pattern").agg(F.count("*").alias("fp_count")).crossJoin(F.broadcast(whole))
    return _listed(counts, rows.where(wrong), "fp_count", "total_negatives", "fp_rate", examples)


def false_negatives(samples: DataFrame, examples: int = 5) -> DataFrame:
    """samples (sample_id, expected, blocked, expected_pattern) -> pattern, fn_count, total_positives (those that expect this pattern, found or missed), fn_rate, example_ids, by falling count; patterns without a miss are left out."""
    rows = samples.where("expected").withColumn("_pattern", F.coalesce("expected_pattern", F.lit("")))
    counts = rows.groupBy("_pattern").agg(F.count_if(~F.col("blocked")).alias("fn_count"), F.count("*").alias("total_positives")).where("fn_count > 0")
    return _listed(counts, rows.where(~F.col("blocked")), "fn_count", "total_positives", "fn_rate", examples)


def _listed(counts: DataFrame, wrong: DataFrame, count: str, whole: str, rate: str, examples: int) -> DataFrame:
    # each task keeps no more than the first ids of a pattern before they meet
    first = Window.partitionBy("_pattern").orderBy("sample_id")
    ids = wrong.select("_pattern", "sample_id", F.row_number().over(first).alias("_place")).where(F.col("_place") <= examples)
    ids = ids.groupBy("_pattern").agg(F.sort_array(F.collect_list("sample_id")).alias("example_ids"))
    out = counts.join(ids, "_pattern", "left").select(F.col("_pattern").alias("pattern"), count, whole, ratio(F.col(count), F.col(whole)).alias(rate), "example_ids")
    return out.orderBy(F.desc(count), "pattern")


def by_category_of(samples: DataFrame, patterns: DataFrame, name: str = "pattern_name") -> DataFrame:
    """samples with the corpus category of their pattern (patterns: pattern, corpus_category); other_generic for unknown ones."""
    known = patterns.select(F.col("pattern").alias("_name"), F.col("corpus_category").alias("_category"))
    return samples.join(known, F.col(name) == F.col("_name"), "left").withColumn("corpus_category", F.coalesce("_category", F.lit("other_generic"))).drop("_name", "_category")


def pack_status(patterns: DataFrame) -> DataFrame:
    """patterns (name, category, prefix) -> one row: patterns, prefixes (distinct, folded, without empty ones), categories (sorted and joined; empty ones are uncategorized)."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    prefix = F.nullif(F.lower(F.coalesce("prefix", F.lit(""))), F.lit(""))
    return patterns.agg(F.count("*").alias("patterns"), F.count_distinct(prefix).alias("prefixes"), F.array_join(F.sort_array(F.collect_set(category)), ",").alias("categories"))


def budget_check(report: DataFrame) -> DataFrame:
    """accuracy_by's rows -> within_budget."""
    limit = F.when(F.col("overall") == 1, BUDGET["fn_rate"]).otherwise(BUDGET["category_fn_rate"])
    return report.withColumn("within_budget", (F.col("fn_rate") <= limit) & ((F.col("overall") == 0) | (F.col("fp_rate") <= BUDGET["fp_rate"])))


def regression(baseline: DataFrame, current: DataFrame, category: str) -> DataFrame:
    """Rows of both reports by category -> why it is worse (null: it is not)."""
    now = current.select(category, F.col("recall").alias("recall_now"), F.col("fp_rate").alias("fp_now"))
    rows = baseline.select(category, "recall", "fp_rate").join(now, category, "left")
    why = F.when(F.col("recall_now").isNull(), "missing").when(F.col("recall_now") < F.col("recall") - RECALL_DROP, "recall").when(F.col("fp_now") > F.col("fp_rate") + FP_RISE, "false positives")
    return rows.withColumn("violation", why)

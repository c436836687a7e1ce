"""Ordered analytics: edges, deltas, id order, budgets, and rules that depend on the last accepted row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bad_edges(events: DataFrame, key: str, ts: str, ok: str, tie: str) -> DataFrame:
    """Rows at which ok turns false; before the first row all was well, and a null counts as ok."""
    event = lambda c: F.col("event").getField(c)
    fine = F.coalesce(event(ok), F.lit(True))
    before = F.lag(fine, 1, True).over(Window.partitionBy(event(key)).orderBy(event(ts), event(tie)))
    return events.select(F.struct(*events.columns).alias("event")).withColumn("was_ok", before).where(F.col("was_ok") & ~fine).select("event.*")


def deltas(rows: DataFrame, key: str, order: list[str], counter: str) -> DataFrame:
    """Positive steps of a counter between polls, as delta (a column of this name is replaced)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("delta", F.col(counter) - F.lag(counter).over(w)).where("delta > 0")


def newest(rows: DataFrame, key: str, order: list, n: int = 10) -> DataFrame:
    """The last n rows of each key, with their place (a column of this name is replaced)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def id_rollbacks(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    """With rejected: the number is not above all that came before (or above 0)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("rejected", F.col(number) <= F.greatest(F.coalesce(F.max(number).over(w), F.lit(0)), F.lit(0)))


def within_budget(files: DataFrame, key: str, order: list[str], size: str, cap: int) -> DataFrame:
    """Files with taken, how many of their bytes still fit, and truncated (columns of these names are replaced)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col(size), cap - before))
    return files.withColumn("taken", taken).withColumn("truncated", F.col("taken") < F.col(size))


def joined_files(files: DataFrame, key: str, order: str, text: str, cap: int) -> DataFrame:
    """Each key's texts within the byte cap, joined by line ends in order."""
    rows = within_budget(files.withColumn("_size", F.octet_length(text)), key, [order], "_size", cap).where("taken > 0 or _size = 0")
    cut = F.decode(F.substring(F.encode(F.col(text), "utf-8"), F.lit(1), F.col("taken")), "utf-8")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), cut.alias("t")))), lambda s: s.t), "\n").alias("text"), F.bool_or("truncated").alias("truncated"))


_NOBODY = object()


def _keys(column: pd.Series) -> list:
    """Values with None for null (pandas' NaN differs from itself)."""
    return column.astype(object).where(column.notna(), None).tolist()


def first_of(files: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Of files that are the same by these columns, the first one in order; nulls are equal."""
    kept = F.min_by(F.struct(*files.columns), F.struct(*order)).alias("_f")
    return files.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(same)]).agg(kept).select("_f.*")


def token_bucket(rows: DataFrame, key: str, seconds: str, tie: str, rate: float, burst: float) -> DataFrame:
    """rows (key, seconds, tie) -> with allowed: a bucket refills by elapsed time and each allowed row takes one; it holds one token at least, and a rate of 0 or less allows all. Null keys are one key. The state is one number per key, carried from batch to batch, so a key's rows are never gathered."""
    if rate <= 0:
        return rows.withColumn("allowed", F.lit(True))
    schema, burst = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", allowed boolean", max(burst, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, who = burst, None, _NOBODY
        for batch in batches:
            out = []
            for k, t in zip(_keys(batch[key]), batch[seconds], strict=True):
                if k != who:
                    held, last, who = burst, t, k
                held, last = min(burst, held + max(0.0, t - last) * rate), t
                out.append(held >= 1)
                held -= held >= 1
            yield batch.assign(allowed=pd.Series(out, dtype="bool", index=batch.index))

    return rows.repartition(key).sortWithinPartitions(key, seconds, tie).mapInPandas(run, schema)


def throttled(rows: DataFrame, key: str, seconds: str, tie: str, mark: str, gap: float = 1.5) -> DataFrame:
    """With accepted: not within gap of the last accepted row, and not with its mark. Null keys are one key."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last, seen = _NOBODY, None, None
        for batch in batches:
            out = []
            for k, t, m in zip(_keys(batch[key]), batch[seconds], _keys(batch[mark]), strict=True):
                if k != who:
                    who, last, seen = k, None, None
                ok = (last is None or t - last >= gap) and m != seen
                if ok:
                    last, seen = t, m
                out.append(ok)
            yield batch.assign(accepted=pd.Series(out, dtype="bool", index=batch.index))

    return rows.repartition(key).sortWithinPartitions(key, seconds, tie).mapInPandas(run, schema)

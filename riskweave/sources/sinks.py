"""Writers of policies, counters, versions, reports and corpora. Each table is replaced whole by a new folder's rename or appended to."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.policy import DLP_KEYS, checked_config

COUNTERS = ("dns_queries", "dns_blocks", "dlp_scans", "dlp_blocks", "tamper_events")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only on a local master where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/riskweave"


def _places(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, now = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in (".new", ".old", ""))
    return now.getFileSystem(conf), new, old, now


def replaced(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside the table, moves the table aside and the new one in its place, so a plan may read what it replaces. What a crash leaves at any step, recovered() puts right: the old table or the whole new one is always there."""
    spark = df.sparkSession
    recovered(spark, path)
    df.write.mode("overwrite").format(form).save(f"{path}.new")
    where, new, old, now = _places(spark, path)
    if where.exists(now):
        where.rename(now, old)
    where.rename(new, now)
    where.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Ends a replacement that was cut off; whether the table is there. A new table counts once its writer has marked it as whole."""
    where, new, old, now = _places(spark, path)
    if not where.exists(now):
        whole = where.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.new/_SUCCESS"))
        if where.exists(old):
            where.rename(new if whole else old, now)
        else:  # the first table, perhaps cut off before its move
            return whole and where.rename(new, now)
    where.delete(old, True)
    return True


def zero_counters(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in COUNTERS])


def added(totals: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters after adding any number of delta rows; no delta changes nothing."""
    return totals.unionByName(delta).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def append_version(spark: SparkSession, path: str, version: str, number: int) -> None:
    spark.createDataFrame([(number, version)], "id long, version string").write.mode("append").parquet(path)


def reset_counters(spark: SparkSession, path: str) -> None:
    replaced(zero_counters(spark), path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policies in order of category."""
    return spark.read.parquet(path).select("category", "action").orderBy("category")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COUNTERS)


def replace_config(config: DataFrame, path: str) -> None:
    """Replaces the one row of scan numbers, if they are valid."""
    replaced(checked_config(config).select(*DLP_KEYS), path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*DLP_KEYS)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.max_by("version", "id").alias("version"))


def write_override(entries: DataFrame, path: str) -> None:
    """A small sorted text file of distinct entries, replaced as a whole."""
    replaced(entries.select("entry").distinct().orderBy("entry").coalesce(1), path, "text")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_corpus(samples: DataFrame, path: str) -> None:
    samples.withColumn("content_b64", F.base64(F.encode("text", "utf-8"))).drop("text").write.mode("overwrite").partitionBy("kind", "category").json(path)


def export_envelope(stats: DataFrame, at: Column) -> DataFrame:
    return stats.select(F.to_json(F.struct(at.alias("exported_at"), F.struct(*stats.columns).alias("stats"))).alias("json"))


def heartbeat(stats: DataFrame, version: str, os: str, at: Column) -> DataFrame:
    """Four fields and no more."""
    return stats.select(F.to_json(F.struct(F.lit(version).alias("agent_version"), F.lit(os).alias("os_type"), at.alias("sent_at"), F.struct(*stats.columns).alias("aggregate_counters"))).alias("json"))

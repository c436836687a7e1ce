"""Domain decisions: rule precedence, nearest-suffix look-up, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.text import fold, plausible_host


def rule_table(spark: SparkSession, sources: list[list[tuple[str, str]]]) -> DataFrame:
    """Sources of (category, entry) -> source_ord, line_ord, category, host, is_wildcard."""
    rows = [(s, i, c, e.lower().removeprefix("."), e.startswith(".")) for s, entries in enumerate(sources) for i, (c, e) in enumerate(entries)]
    return spark.createDataFrame(rows, "source_ord int, line_ord int, category string, host string, is_wildcard boolean")


def effective(rules: DataFrame, overrides_first: bool = False) -> DataFrame:
    """The first entry of each host and kind, in order of source and line (with overrides_first: the last source wins)."""
    source = F.col("rule.source_ord")
    order = [source.desc() if overrides_first else source, F.col("rule.line_ord")]
    # as one column, so that no name of the caller's is in the way
    first = F.row_number().over(Window.partitionBy("rule.host", "rule.is_wildcard").orderBy(*order))
    return rules.select(F.struct(*rules.columns).alias("rule")).withColumn("k", first).where("k = 1").select("rule.*")


def suffixes(host: Column) -> Column:
    """Array of (suffix, depth); depth 0 is the host itself."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix"), i.alias("depth")))


def resolved(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host) -> distinct host and category (null: no entry). An exact entry wins, else the nearest wildcard; a wildcard fits its own host too. Distinct hosts are resolved once, however often they occur."""
    known = hosts.select("host").where("host is not null").distinct()
    clean = F.regexp_replace(fold(F.trim("host")), r"\.$", "")
    keys = known.select("host", F.inline(suffixes(clean)))
    best = keys.join(effective(rules).withColumnRenamed("host", "suffix"), "suffix").where("is_wildcard or depth = 0")
    nearest = best.groupBy("host").agg(F.min_by("category", F.struct(F.when(F.col("is_wildcard"), 1).otherwise(0), "depth")).alias("category"))
    return known.join(nearest, "host", "left")


def decided(hosts: DataFrame, rules: DataFrame, policies: DataFrame) -> DataFrame:
    """host, category, action, rcode: no entry allows; a category without a policy denies."""
    rows = resolved(hosts, rules).join(F.broadcast(policies.select("category", "action")), "category", "left")
    action = F.when(F.col("category").isNull(), "allow").otherwise(F.coalesce("action", F.lit("deny")))
    return rows.select("host", "category", action.alias("action")).withColumn("rcode", F.when(F.col("host") == "", "FORMERR").when(F.col("action") == "deny", "NXDOMAIN").otherwise("FORWARD"))


def hosts_with_action(rules: DataFrame, policies: DataFrame, action: str = "allow_with_dlp") -> DataFrame:
    """Distinct hosts, exact or wildcard, whose category has the action."""
    return effective(rules).join(policies.where(F.col("action") == action), "category", "left_semi").select("host").distinct()


def last_write(commands: DataFrame) -> DataFrame:
    """commands (domain, list, seq) -> the list each domain is on now: allow and block exclude each other."""
    return commands.groupBy("domain").agg(F.max_by("list", "seq").alias("list"))


def merged(base: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """base with rows of the same key replaced by overrides, others appended; same columns."""
    marked = overrides.select(*key, F.lit(True).alias("_own"))
    return base.join(marked, key, "left").where("_own is null").drop("_own").unionByName(overrides)


def new_hosts(remote: DataFrame, known: DataFrame) -> DataFrame:
    return remote.select(fold(F.trim("host")).alias("host")).where(plausible_host(F.col("host"))).distinct().join(known, "host", "left_anti")


def manifest_delta(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest entries (name, sha256) that are safe file names with whole digests and are not there yet."""
    safe = ~F.col("name").rlike(r"[/\\]|\.\.|^\.") & (F.length("sha256") == 64)
    low = lambda df: df.withColumn("sha256", F.lower("sha256"))
    return low(manifest).where(safe).join(low(present).select("name", "sha256"), ["name", "sha256"], "left_anti")

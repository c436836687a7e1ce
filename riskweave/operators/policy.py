"""Decisions from verdicts, and validation of configuration tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEBIBYTE = 1 << 20
MIN_SCAN = 50
#: What a category may do, and the categories that are always known.
ACTIONS = ("allow", "allow_with_dlp", "deny")
KNOWN = ("AI Chat Blocked", "AI Code Blocked", "AI Allowed", "AI Chat DLP", "Phishing", "Social", "News", "allow_admin", "block_admin")


def oversize(mode: Column) -> Column:
    return F.when(mode == "managed", "block").otherwise("allow")


def unavailable(mode: Column) -> Column:
    return F.when(mode == "managed", "block").when(mode == "team", "warn").otherwise("allow")


#: Fixed names of what decides where no pattern does.
OVERSIZE, UNAVAILABLE = "policy:oversize", "policy:agent-unavailable"


def enforced(rows: DataFrame) -> DataFrame:
    """rows (mode, size in bytes, blocked or null, pattern_name, score) -> with decision and the effective pattern_name and score."""
    big, none = F.col("size") > MEBIBYTE, F.col("blocked").isNull()
    decision = F.when(big, oversize(F.col("mode"))).when(none, unavailable(F.col("mode"))).when(F.col("blocked"), "block").otherwise("allow")
    name = F.when(big, OVERSIZE).when(none, UNAVAILABLE).otherwise(F.coalesce("pattern_name", F.lit("")))
    return rows.withColumns({"decision": decision, "effective_pattern": name, "effective_score": F.when(big | none, 0).otherwise(F.coalesce("score", F.lit(0))).cast("long")})


def worth_scanning(text: Column) -> Column:
    return F.length(text) >= MIN_SCAN


def acceptable_category(c: Column, registered: list[str] | None = None) -> Column:
    return c.isin(*KNOWN, *(registered or [])) | c.rlike("^[a-z][a-z0-9_]*_admin$")


def violations(config: DataFrame) -> DataFrame:
    """config (name, mode, and what the modes require: allowed_extension_ids array, api_token_path, api_token_required, bridge_mac_required, profile_public_key, rule_update_public_key, profile_path, profile_url) -> name, violations (array of the keys that fail, in this order). A column that is not there counts as not set; blank text, too."""
    kinds = dict(config.dtypes)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in kinds else F.lit("")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in kinds else F.lit(False)
    ids = F.coalesce(F.exists("allowed_extension_ids", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(False)) if "allowed_extension_ids" in kinds else F.lit(False)
    managed = F.col("mode") == "managed"
    strict = F.col("mode").isin("team", "managed")
    tests = [
        (strict & ~ids, "allowed_extension_ids"),
        (strict & (text("api_token_path") == ""), "api_token_path"),
        (strict & ~flag("api_token_required"), "api_token_required"),
        (managed & ~flag("bridge_mac_required"), "bridge_mac_required"),
        (managed & (text("profile_public_key") == ""), "profile_public_key"),
        (managed & (text("rule_update_public_key") == ""), "rule_update_public_key"),
        (managed & (text("profile_path") == "") & (text("profile_url") == ""), "profile_path or profile_url"),
    ]
    return config.select("name", F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests])).alias("violations"))


#: Fixed: the numbers of a scan configuration, and what they must be.
DLP_KEYS = ("threshold_critical", "threshold_high", "threshold_medium", "threshold_low", "hotword_boost", "entropy_boost", "entropy_penalty", "exclusion_penalty", "multi_match_boost")


def merged_config(current: DataFrame, override: DataFrame) -> DataFrame:
    """One row of DLP_KEYS -> the numbers with those of the override that are neither null nor 0. An override without a row changes nothing; of several rows it fails."""
    named = [k for k in DLP_KEYS if k in override.columns]
    # one row in any case: aggregates of no row are null
    own = override.agg(*[F.max(k).alias(f"_{k}") for k in named], F.count("*").alias("_rows"))
    one = F.when(F.col("_rows") > 1, F.raise_error(F.lit("more than one row of numbers"))).otherwise(0)
    value = lambda k: F.coalesce(F.nullif(F.col(f"_{k}"), one), F.col(k)).alias(k) if k in named else F.col(k)
    return current.crossJoin(F.broadcast(own)).select(*map(value, DLP_KEYS))


#: Fixed: the most that a weight may add or take.
WEIGHT_MAX = 100


def valid_config() -> Column:
    """Thresholds are positive, and weights within WEIGHT_MAX of 0; a null is neither."""
    ok = F.lit(True)
    for k in DLP_KEYS:
        ok = ok & (F.col(k) > 0 if k.startswith("threshold") else F.col(k).between(-WEIGHT_MAX, WEIGHT_MAX))
    return F.coalesce(ok, F.lit(False))


def checked_config(config: DataFrame) -> DataFrame:
    """config, if it is one row of valid numbers."""
    if config.agg(F.count("*").alias("n"), F.count_if(valid_config()).alias("good")).head() != (1, 1):
        raise ValueError("numbers out of range: one row of valid ones is wanted")
    return config


def applied_profile(policies: DataFrame, config: DataFrame, changes: DataFrame, override: DataFrame) -> tuple[DataFrame, DataFrame]:
    """policies and config after a profile's changes, both or neither: all is checked before anything is returned."""
    fresh = checked_config(merged_config(config, override))
    return with_policy(policies, changes), fresh


def registered(*names: DataFrame) -> DataFrame:
    """Union of tables (category): trimmed, distinct, without empty ones."""
    rows = reduce(DataFrame.unionByName, [n.select(F.trim("category").alias("category")) for n in names])
    return rows.where("category <> ''").distinct()


def profile_violations(profiles: DataFrame) -> DataFrame:
    """profiles (name, categories map of actions, dlp_thresholds struct critical, high, medium, low) -> name, violations: why a profile cannot be used, in the order of these columns. Null maps, structs and numbers are not set."""
    t = lambda k: F.coalesce(F.col("dlp_thresholds").getField(k), F.lit(0)) < 0
    wrong = F.array_sort(F.map_keys(F.map_filter("categories", lambda _, action: ~F.coalesce(action.isin(*ACTIONS), F.lit(False)))))
    tests = F.concat(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform(wrong, lambda c: F.concat(F.lit("action of "), c)), F.array().cast("array<string>")),
        F.when(t("critical") | t("high") | t("medium") | t("low"), F.array(F.lit("dlp_thresholds"))).otherwise(F.array().cast("array<string>")),
    )
    return profiles.select("name", tests.alias("violations"))


def merged_rules(base: DataFrame, over: DataFrame, key: list[str], order: str) -> DataFrame:
    """base after the rules of over, both in order of a column of places: a rule of over takes the place of the last one of base with its key, or comes after all, in the order in which keys are first met; of those of one key the last counts. Key columns may be null, empty or arrays. Places are numbered anew, from 0."""
    of = lambda rows: rows.select(F.struct(*key).alias("_key"), F.col(order).cast("long").alias("_at"), F.struct(*[c for c in base.columns if c != order]).alias("_rule"))
    fresh = of(over).groupBy("_key").agg(F.max_by("_rule", "_at").alias("_new"), F.min("_at").alias("_first"))
    last = of(base).groupBy("_key").agg(F.max("_at").alias("_at"))
    # places in base that change; null keys are keys as others, so they join within a struct
    taken = last.join(fresh, "_key").select("_at", "_new")
    kept = of(base).join(taken, "_at", "left").select(F.lit(0).alias("_part"), "_at", F.coalesce("_new", "_rule").alias("_rule"))
    added = fresh.join(last, "_key", "left_anti").select(F.lit(1).alias("_part"), F.col("_first").alias("_at"), F.col("_new").alias("_rule"))
    # a pack of rules is small: some thousand rows
    place = F.row_number().over(Window.orderBy("_part", "_at")) - 1
    return kept.unionByName(added).select(place.cast("long").alias(order), "_rule").select(order, "_rule.*")


#: Fixed: what makes two exclusions, and two patterns, the same.
EXCLUSION_KEY, PATTERN_KEY = ["type", "applies_to", "pattern", "words"], ["name"]


def with_policy(policies: DataFrame, changes: DataFrame, order: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """policies (category, action) after changes of the same shape; nothing changes if one of them is not valid. names: registered categories, which are valid besides the known ones. Of changes to one category the last by the column `order` counts; without such a column they have to agree."""
    known = acceptable_category(F.col("category"))
    rows = changes
    if names is not None:
        rows = changes.join(registered(names).select(F.col("category").alias("_category"), F.lit(True).alias("_registered")), F.col("category") == F.col("_category"), "left")
        known = known | F.coalesce("_registered", F.lit(False))
    bad = F.count_if(~F.coalesce(known & F.col("action").isin(*ACTIONS), F.lit(False)))
    if rows.agg(bad).head()[0]:
        raise ValueError("an unknown category or action")
    last = F.max_by("action", order) if order else F.when(F.count_distinct("action") == 1, F.max("action")).otherwise(F.raise_error(F.concat(F.lit("changes that differ: "), F.col("category"))))
    once = changes.groupBy("category").agg(last.alias("action"))
    return policies.join(once, "category", "left_anti").select("category", "action").unionByName(once)


def bypassing(hosts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Hosts to inspect: without those pinned."""
    return hosts.select(F.lower("host").alias("host")).join(pinned.select(F.lower("host").alias("host")), "host", "left_anti")

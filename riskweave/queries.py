"""Registered queries of the library's own operators, over whole tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import sqlfunctions
from riskweave.functions.macs import request_mac
from riskweave.functions.text import RISKY_EXTENSIONS, base_name, content_type, entropy, extension, fingerprint, is_risky, normal_domain, split_address
from riskweave.operators import automaton, domains, embed, ordered, policy, report, samples, scan, vectors
from riskweave.plans.packs import DOMAINS, EXCLUSIONS, PATTERNS, POLICIES, ScanConfig
from riskweave.sources import frame_source, snapshots
from riskweave.sources.sinks import shared_folder
from riskweave.streaming import event_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir) -> DataFrame:
    return scan.spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text"))


def _scored(spark, sf_dir) -> DataFrame:
    return scan.scored(scan.matches(_documents(spark, sf_dir), PATTERNS, rules=EXCLUSIONS), PATTERNS, EXCLUSIONS)


def classify_documents(spark, sf_dir):
    return scan.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", content_type(F.col("text")).alias("content_type"))


def classify_conversations(spark, sf_dir):
    return scan.spread(_table(spark, sf_dir, "conversations").select("text")).groupBy(content_type(F.col("text")).alias("content_type")).agg(F.count("*").alias("n"))


def prefix_candidates(spark, sf_dir):
    return scan.candidates(_documents(spark, sf_dir), PATTERNS)


def regex_matches(spark, sf_dir):
    return scan.matches(_documents(spark, sf_dir), PATTERNS).select("content_id", "pattern", "value", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "num_matches")


def prefix_hits(spark, sf_dir):
    return automaton.prefix_hits(_documents(spark, sf_dir), PATTERNS)


def dictionary_counts(spark, sf_dir):
    """A dictionary of some hundred entries, the first three words of each benchmark item, in all documents."""
    first = F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0)
    entries = [r.entry for r in _table(spark, sf_dir, "benchmark").select(first.alias("entry")).distinct().collect()]
    rows = automaton.dictionary_hits(_documents(spark, sf_dir), entries)
    return rows.groupBy("word").agg(F.count("*").alias("hits"), F.count_distinct("content_id").alias("documents"))


def windowed_matches(spark, sf_dir):
    """Matches in long texts as the rules with a prefix see them: near the prefix only."""
    return scan.matches(_documents(spark, sf_dir), PATTERNS, ScanConfig(windowed=True)).select("content_id", "pattern", "value", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "num_matches")


def match_entropy(spark, sf_dir):
    return scan.matches(_documents(spark, sf_dir), PATTERNS).select("content_id", "pattern", F.col("start").cast("long").alias("start"), F.round(entropy(F.col("value")), 6).alias("entropy"))


def hotword_context(spark, sf_dir):
    return _scored(spark, sf_dir).select("content_id", "pattern", F.col("start").cast("long").alias("start"), "hotword")


def exclusion_eval(spark, sf_dir):
    return _scored(spark, sf_dir).select("content_id", "pattern", F.col("start").cast("long").alias("start"), "suppressed", "penalised")


def score_matches(spark, sf_dir):
    return _scored(spark, sf_dir).select("content_id", "pattern", F.col("start").cast("long").alias("start"), "score")


def scan_documents(spark, sf_dir):
    return scan.scan(_documents(spark, sf_dir), PATTERNS, EXCLUSIONS)


def scan_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("content_id"), "text")
    return scan.scan(rows, PATTERNS, EXCLUSIONS).select("content_id.conv_id", "content_id.turn", "blocked", "pattern_name", "score")


def scan_large(spark, sf_dir):
    """The rule on large contents, with a size that many documents reach."""
    return scan.scan(_documents(spark, sf_dir), PATTERNS, EXCLUSIONS, ScanConfig(large=2_000))


def severity_guard(spark, sf_dir):
    return scan.severity_guard(scan.candidates(_documents(spark, sf_dir), PATTERNS), PATTERNS)


def _page_rules(spark, sf_dir) -> DataFrame:
    """Rules as pages name them: three sources, the host with its subdomains on every second page, the path's first part as category."""
    category = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    return _hosts(spark, sf_dir).join(_table(spark, sf_dir, "pages").select("page_id", category.alias("category")), "page_id").where("host is not null").select((F.col("page_id") % 3).cast("int").alias("source_ord"), F.col("page_id").alias("line_ord"), "category", "host", (F.col("page_id") % 2 == 0).alias("is_wildcard"))


def status_counts(spark, sf_dir):
    """What a status page tells of a pack and an index: categories, prefixes and patterns, here the sources and first words of documents, and the index that pages make."""
    pack = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("category"), F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]*)", 1).alias("prefix"))
    hosts = domains.effective(_page_rules(spark, sf_dir)).agg(F.count_if(~F.col("is_wildcard")).alias("exact_hosts"), F.count_if("is_wildcard").alias("wildcard_hosts"), F.count("*").alias("index_size"))
    return report.pack_status(pack).crossJoin(F.broadcast(hosts))


def config_violations(spark, sf_dir):
    """Configurations made from the nations: each lacks other keys."""
    i = F.col("n_nationkey")
    some = lambda k, value: F.when(i % k != 0, value)
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.element_at(F.array(*map(F.lit, ("personal", "team", "managed"))), (i % 3 + 1).cast("int")).alias("mode"), some(2, F.array("n_name")).alias("allowed_extension_ids"), some(5, F.lit("/token")).alias("api_token_path"), (i % 7 != 0).alias("api_token_required"), (i % 4 != 0).alias("bridge_mac_required"), some(11, F.lit(" ab ")).alias("profile_public_key"), F.when(i % 8 == 0, "  ").otherwise("cd").alias("rule_update_public_key"), some(10, F.lit("/p")).alias("profile_path"), F.when(i == 20, "u").alias("profile_url"))
    return policy.violations(rows).select("name", F.array_join("violations", ",").alias("violations"))


def scan_dedup(spark, sf_dir):
    return scan.scan_distinct(_documents(spark, sf_dir), PATTERNS, EXCLUSIONS).select("content_id", "blocked", "pattern_name", "score")


def _by(spark, sf_dir, column) -> DataFrame:
    verdicts = scan_documents(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), column)
    return verdicts.join(docs, "content_id").groupBy(column).agg(F.count("*").alias("scans"), F.count_if(F.col("blocked")).alias("blocks"), F.max("score").alias("top_score"))


def scan_by_source(spark, sf_dir):
    return _by(spark, sf_dir, "source")


def scan_by_lang(spark, sf_dir):
    return _by(spark, sf_dir, "lang")


def blocked_counters(spark, sf_dir):
    return scan_documents(spark, sf_dir).agg(F.count("*").alias("dlp_scans"), F.count_if(F.col("blocked")).alias("dlp_blocks"))


def _hosts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", normal_domain(F.col("url")).alias("host"))


def resolve_page_hosts(spark, sf_dir):
    pages = _hosts(spark, sf_dir)
    return pages.join(domains.resolved(pages, domains.rule_table(spark, DOMAINS)), "host", "left").select("page_id", "host", "category")


def _policies(spark) -> DataFrame:
    return spark.createDataFrame(POLICIES, "category string, action string")


def dns_verdicts(spark, sf_dir):
    verdicts = domains.decided(_hosts(spark, sf_dir), domains.rule_table(spark, DOMAINS), _policies(spark))
    return _hosts(spark, sf_dir).join(verdicts, "host").groupBy("action", "rcode").agg(F.count("*").alias("n"))


def tier2_hosts(spark, sf_dir):
    """Hosts of pages whose category is scanned, by what the categories of pages may do."""
    actions = _page_rules(spark, sf_dir).select("category").distinct().withColumn("action", F.when(F.col("category").isin("de", "fr"), "allow_with_dlp").otherwise("allow"))
    return domains.hosts_with_action(_page_rules(spark, sf_dir), actions)


def rule_precedence(spark, sf_dir):
    return domains.effective(_page_rules(spark, sf_dir)).select("host", "is_wildcard", "category")


def override_merge(spark, sf_dir):
    base = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("weight"))
    overrides = base.where("weight = 1").select("name", (F.col("weight") + 10).alias("weight")).unionByName(base.where("weight = 2").select(F.concat("name", F.lit("*")).alias("name"), "weight"))
    return domains.merged(base, overrides, ["name"])


def _samples(spark, sf_dir) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("toxic") == 1).alias("expected"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    verdicts = scan_documents(spark, sf_dir).withColumnRenamed("content_id", "sample_id")
    return labels.join(docs, "sample_id").join(verdicts, "sample_id")


def accuracy_report(spark, sf_dir):
    return report.accuracy(_samples(spark, sf_dir))


def accuracy_by_lang(spark, sf_dir):
    return report.budget_check(report.accuracy_by(_samples(spark, sf_dir), "lang"))


def pattern_fp(spark, sf_dir):
    return report.false_positives(_samples(spark, sf_dir)).select("pattern", "fp_count", "total_negatives", "fp_rate")


def pattern_fn(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("expected_pattern", F.concat(F.lit("of "), "lang"))
    return report.false_negatives(rows).select("pattern", "fn_count", "total_positives", "fn_rate")


def report_examples(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    both = [report.false_positives(rows).select(F.lit("fp").alias("kind"), "pattern", "example_ids"), report.false_negatives(rows.withColumn("expected_pattern", F.col("lang"))).select(F.lit("fn").alias("kind"), "pattern", "example_ids")]
    return both[0].unionByName(both[1]).select("kind", "pattern", F.array_join(F.transform("example_ids", lambda x: x.cast("string")), ",").alias("example_ids"))


def corpus_categories(spark, sf_dir):
    known = spark.createDataFrame([(p.name, p.category) for p in PATTERNS if p.category != "network"], "pattern string, corpus_category string")
    return report.by_category_of(scan_documents(spark, sf_dir).where("blocked"), known).groupBy("corpus_category").agg(F.count("*").alias("n"))


def accuracy_regression(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    base = report.accuracy_by(rows, "lang").where("overall = 0")
    now = report.accuracy_by(rows.where("lang <> 'es'").withColumn("blocked", F.col("blocked") | (F.col("lang") == "fr")), "lang").where("overall = 0")
    return report.regression(base, now, "lang").select("lang", "violation")


def centroids(spark, sf_dir):
    rows = vectors.centroids(_table(spark, sf_dir, "embeddings"))
    return rows.select("label", F.posexplode("centroid").alias("pos", "x")).select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _sides(spark, sf_dir) -> tuple[list[float], list[float]]:
    got = {r.label: r.centroid for r in vectors.centroids(_table(spark, sf_dir, "embeddings").where("label < 2")).collect()}
    return got[0], got[1]


def prefilter_verdicts(spark, sf_dir):
    tp, tn = _sides(spark, sf_dir)
    return vectors.prefilter(_table(spark, sf_dir, "embeddings"), tp, tn, 0.1).select("vec_id", "margin", "verdict")


def linear_head(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").where("label < 2")
    return vectors.linear_head(rows, F.col("label") == 0).select(F.round("bias", 6).alias("bias"), F.round(F.col("weights")[0], 6).alias("first_weight"), "tp_right", "tn_right")


def disambiguator_scores(spark, sf_dir):
    head = vectors.linear_head(_table(spark, sf_dir, "embeddings").where("label < 2"), F.col("label") == 0)
    rows = _table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(head.select("weights", "bias")))
    return rows.select("vec_id", F.round(vectors.head_score(F.col("embedding"), F.col("weights"), F.col("bias")), 6).alias("head_score"))


def scan_with_ml(spark, sf_dir):
    heads = disambiguator_scores(spark, sf_dir).select(F.col("vec_id").alias("_vec"), F.col("head_score").alias("_head"))
    rows = scan.matches(_documents(spark, sf_dir), PATTERNS, rules=EXCLUSIONS)
    rows = rows.join(heads, F.col("content_id") == F.col("_vec"), "left").withColumn("ml_score", F.coalesce("_head", F.lit(0.0)))
    cfg = ScanConfig(ml=1)
    return scan.pattern_verdicts(scan.scored(rows, PATTERNS, EXCLUSIONS, cfg), PATTERNS, cfg).select("content_id", "pattern", "num_matches", "score", "blocked")


def tamper_edges(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return ordered.bad_edges(events, "user_id", "ts", "ok", "event_id").select("event_id", "user_id")


def _polls(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("counter"))


def counter_deltas(spark, sf_dir):
    return ordered.deltas(_polls(spark, sf_dir), "user_id", ["ts", "event_id"], "counter").select("event_id", "user_id", "delta")


def last_notifications(spark, sf_dir):
    rows = ordered.deltas(_polls(spark, sf_dir), "user_id", ["ts", "event_id"], "counter")
    return ordered.newest(rows, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "delta", F.col("place").cast("long").alias("place"))


def id_rollback(spark, sf_dir):
    rows = _polls(spark, sf_dir)
    return ordered.id_rollbacks(rows, "user_id", ["ts", "event_id"], "counter").groupBy("user_id").agg(F.count_if(F.col("rejected")).alias("rejected"), F.count("*").alias("n"))


def byte_budget(spark, sf_dir):
    files = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return ordered.within_budget(files, "conv_id", ["turn"], "size", 2000).select("conv_id", "turn", F.col("taken").cast("long").alias("taken"), "truncated")


def enforcement_decisions(spark, sf_dir):
    verdicts = scan_documents(spark, sf_dir).withColumnRenamed("content_id", "doc_id")
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 400).cast("long").alias("size")).join(verdicts, "doc_id")
    mode = F.element_at(F.array(F.lit("personal"), F.lit("team"), F.lit("managed")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    rows = rows.withColumn("mode", mode).withColumn("blocked", F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("blocked")))
    return policy.enforced(rows).select("doc_id", "decision", "effective_pattern", "effective_score")


def risky_extensions(spark, sf_dir):
    name = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return _table(spark, sf_dir, "pages").select(extension(name).alias("extension"), is_risky(name, [*RISKY_EXTENSIONS, "html"]).alias("risky")).groupBy("extension", "risky").agg(F.count("*").alias("n"))


def manifest_delta(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id")).alias("name"), F.sha2("html", 256).alias("sha256"), "page_id")
    present = pages.where("page_id % 3 = 0").select("name", F.upper("sha256").alias("sha256"))
    return domains.manifest_delta(pages.withColumn("name", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "name")).otherwise(F.col("name"))), present).select("name", "sha256")


def clipboard_fingerprints(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", fingerprint(F.col("text")).alias("fingerprint"))


def _timed(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("seconds"))


def rate_limit(spark, sf_dir):
    return ordered.token_bucket(_timed(spark, sf_dir), "user_id", "seconds", "event_id", 1 / 20_000, 2.0).groupBy("user_id").agg(F.count_if(F.col("allowed")).alias("allowed"), F.count("*").alias("n"))


def clipboard_throttle(spark, sf_dir):
    return ordered.throttled(_timed(spark, sf_dir), "user_id", "seconds", "event_id", "event_type", 3_600.0).groupBy("user_id").agg(F.count_if(F.col("accepted")).alias("accepted"), F.count("*").alias("n"))


def _events(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", (F.col("event_type") != "error").alias("ok"))


#: Rows may come two hours late; users are not forgotten however long they are idle, as in the queries on the whole table.
_WAIT = {"late": "120 minutes", "idle": 1e9}


def streamed_edges(spark, sf_dir):
    """tamper_edges over the events as a stream, out of order by up to an hour."""
    out = event_order.replayed(_events(spark, sf_dir), "ts", lambda s: event_order.edges(s, "user_id", "ts", "event_id", "ok", **_WAIT), 7200)
    return out.where("edge").select("event_id", "user_id")


def streamed_rate_limit(spark, sf_dir):
    """rate_limit, row by row, over the same stream."""
    out = event_order.replayed(_events(spark, sf_dir), "ts", lambda s: event_order.limited(s, "user_id", "ts", "event_id", 1 / 20_000, 2.0, late=_WAIT["late"]), 7200)
    return out.select("event_id", "user_id", "allowed")


def streamed_throttle(spark, sf_dir):
    """clipboard_throttle, row by row, over the same stream."""
    out = event_order.replayed(_events(spark, sf_dir), "ts", lambda s: event_order.throttled(s, "user_id", "ts", "event_id", "event_type", 3_600.0, **_WAIT), 7200)
    return out.select("event_id", "user_id", "accepted")


def streamed_hello(spark, sf_dir):
    """The first event of each user."""
    out = event_order.replayed(_events(spark, sf_dir), "ts", lambda s: event_order.hello_once(s, "user_id", "ts", "event_id", **_WAIT), 7200)
    return out.where("hello").select("event_id", "user_id")


def _cached(spark, sf_dir) -> DataFrame:
    """All documents twice as a stream, 100 a second, the second time 3 s after the first or, for every second one, 7 s: which look-ups the cache answers."""
    first = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("doc_id") * 10)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    again = F.make_dt_interval(secs=F.when(F.col("doc_id") % 2 == 0, 3).otherwise(7))
    rows = docs.select(F.concat_ws("-", "doc_id", F.lit("a")).alias("who"), first.alias("at"), "text").unionByName(docs.select(F.concat_ws("-", "doc_id", F.lit("b")).alias("who"), (first + again).alias("at"), "text"))
    return event_order.replayed(rows, "at", lambda s: event_order.cached(s, "at", "who", shards=8), 10.0, slices=2)


def cached_scans(spark, sf_dir):
    return _cached(spark, sf_dir).select("who", "hit", "answered_by")


def cache_counts(spark, sf_dir):
    """Of the same look-ups, how many were answered without a scan, for first and second ones."""
    return event_order.cache_counts(_cached(spark, sf_dir).withColumn("turn", F.right("who", F.lit(1))), "turn").select("turn", "hits", "misses")


def profile_snapshots(spark, sf_dir):
    """Policies by source of documents and one row of numbers: a first version, a profile that changes both, a refused profile, and a way back; what readers of each version see."""
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    sources = _table(spark, sf_dir, "documents").where("source is not null").groupBy(F.concat(F.regexp_replace(F.lower("source"), "[^a-z0-9]", "_"), F.lit("_admin")).alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    numbers = spark.createDataFrame([(1, 2, 3, 4, 2, 1, -2, -3, 1)], ", ".join(f"{k} int" for k in policy.DLP_KEYS))
    first = snapshots.commit(snapshots.Snapshot(spark, path), {snapshots.POLICIES: sources.select("category", F.lit("allow").alias("action")), snapshots.CONFIG: numbers}, "first")
    changes = sources.where("chars > 2000 * n").select("category", F.lit("deny").alias("action"))
    override = numbers.select(F.lit(5).alias("threshold_high"), F.lit(0).alias("threshold_low"))
    snapshots.apply_profile(first, changes, override, "profile")
    try:
        snapshots.apply_profile(first, changes, override, "too late")
    except snapshots.Conflict:
        snapshots.rolled_back(spark, path, 1)
    out = None
    for v in snapshots.versions(spark, path):
        pinned = snapshots.Snapshot(spark, path, v)
        seen = pinned.table(snapshots.POLICIES).crossJoin(F.broadcast(pinned.table(snapshots.CONFIG).select("threshold_high", "threshold_low"))).select(F.lit(v).cast("long").alias("version"), "category", "action", "threshold_high", "threshold_low")
        out = seen if out is None else out.unionByName(seen)
    return out


def framed_conversations(spark, sf_dir):
    """Conversations written as length-prefixed frames and read back by the source."""
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("json"))
    written = f"{folder}-written"
    frame_source.write_frames(rows, "json", folder).write.parquet(written)
    spark.dataSource.register(frame_source.FrameSource)
    # files of attempts that were lost are in no row of what was written
    read = spark.read.format("frames").option("chunk", 4096).load(folder).join(spark.read.parquet(written), "file", "left_semi")
    kinds = "conv_id long, turn long, role string, text string"
    return read.where("error is null").select(F.from_json("json", kinds).alias("m")).select("m.*")


def conversation_macs(spark, sf_dir):
    """The code of each conversation row as a request; every fifth key is longer than a block."""
    key = F.when(F.col("conv_id") % 5 == 0, F.repeat(F.concat(F.lit("key "), F.col("conv_id").cast("string")), 20)).otherwise(F.concat(F.lit("k"), F.col("conv_id").cast("string")))
    nonce = F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 32)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", request_mac(key, nonce, F.col("turn"), F.col("role"), F.col("text")).alias("mac"))


def _embedded(spark, sf_dir) -> DataFrame:
    """The vectors are read several times, so they are written once."""
    place = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    embed.embedded(_documents(spark, sf_dir)).withColumnRenamed("content_id", "doc_id").write.parquet(place)
    return spark.read.parquet(place)


def text_second_opinion(spark, sf_dir):
    """Pre-filter and head on vectors of the documents' own texts; centroids from those labelled toxic and not."""
    rows = _embedded(spark, sf_dir)
    labelled = rows.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    sides = {r.label: r.centroid for r in vectors.centroids(labelled).collect()}  # two rows
    head = vectors.linear_head(labelled, F.col("label") == 1)
    out = vectors.prefilter(rows, sides[1], sides[0], 0.01).crossJoin(F.broadcast(head.select("weights", "bias")))
    return out.select("doc_id", "n_tokens", "margin", "verdict", F.round(vectors.head_score(F.col("embedding"), F.col("weights"), F.col("bias")), 6).alias("head_score"))


def planted_recall(spark, sf_dir):
    """One value planted into each document, and whether the scan's matches have it at its place."""
    planted = samples.planted(_documents(spark, sf_dir), PATTERNS, EXCLUSIONS)
    planted = planted.withColumn("key", F.xxhash64("content_id", "text"))
    found = scan.matches(planted.select(F.col("key").alias("content_id"), "text"), PATTERNS, ScanConfig(large=0)).select(F.col("content_id").alias("key"), "pattern", "value", F.col("start").cast("long").alias("start")).distinct().withColumn("hit", F.lit(True))
    rows = planted.select("key", "pattern", "value", "start").join(found, ["key", "pattern", "value", "start"], "left")
    return rows.agg(F.count("*").alias("planted"), F.count("hit").alias("found"))


def sample_corpus(spark, sf_dir):
    """A sample for each document, a fifth of them without a value: how many each pattern has, how many are found, and the same of the kinds of negatives."""
    words = [r.w for r in _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,9}"), F.lit(0))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(50).select("w").collect()]
    rows = samples.corpus(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n")), PATTERNS, EXCLUSIONS, words)
    found = scan.matches(rows.select(F.col("id").alias("content_id"), "text"), PATTERNS).select(F.col("content_id").alias("id"), F.col("pattern").alias("_pattern"), F.col("value").alias("_value"))
    told = rows.join(found, "id", "left").groupBy("id", "pattern", "context").agg(F.bool_or((F.col("_pattern") == F.col("pattern")) & (F.col("_value") == F.col("value"))).alias("hit"), F.count("_pattern").alias("any"))
    name = F.when(F.col("pattern").isNull(), F.concat(F.lit("no value: "), F.col("context"))).otherwise(F.col("pattern"))
    return told.groupBy(name.alias("sample")).agg(F.count("*").alias("n"), F.count_if(F.when(F.col("pattern").isNull(), F.col("any") > 0).otherwise(F.col("hit"))).alias("found"))


def sql_scan(spark, sf_dir):
    """scan_documents, written in SQL."""
    sqlfunctions.register(spark)
    return spark.sql("SELECT content_id, blocked, pattern_name, score FROM scan_text(TABLE(SELECT content_id, text FROM {docs}))", docs=_documents(spark, sf_dir))


def sql_columns(spark, sf_dir):
    sqlfunctions.register(spark)
    return spark.sql("SELECT page_id, host_of(url) AS host, round(entropy(url), 6) AS entropy, classify(html) AS content_type FROM {pages}", pages=_table(spark, sf_dir, "pages"))


def profile_checks(spark, sf_dir):
    """Profiles made from customers: some without a name, with actions that are none, with negative thresholds."""
    c = F.col("c_custkey")
    action = F.element_at(F.array(*map(F.lit, ("allow", "deny", "allow_with_dlp", "permit"))), (c % 4 + 1).cast("int"))
    limits = F.when(c % 5 != 0, F.struct(F.lit(1).alias("critical"), F.floor("c_acctbal").cast("int").alias("high"), F.lit(None).cast("int").alias("medium"), F.lit(4).alias("low")))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(c % 6 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("name"), F.create_map(F.col("c_mktsegment"), action, F.lit("News"), F.lit("allow")).alias("categories"), limits.alias("dlp_thresholds"))
    return policy.profile_violations(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


def exclusion_merge(spark, sf_dir):
    """Exclusions made from parts, two for many keys, and overrides of some and of others."""
    p = F.col("p_partkey")
    rule = lambda window, at: [at.cast("long").alias("at"), F.lit("dictionary").alias("type"), F.col("p_brand").alias("applies_to"), F.when(p % 2 == 0, F.lit("")).alias("pattern"), F.array(F.concat(F.lit("w"), (p % 40).cast("string"))).alias("words"), window.cast("int").alias("window")]
    parts = _table(spark, sf_dir, "part")
    base = parts.where(p % 3 != 0).select(*rule(F.col("p_size"), p))
    over = parts.where(p % 4 == 0).select(*rule(-F.col("p_size"), p))
    return policy.merged_rules(base, over, policy.EXCLUSION_KEY, "at").select(F.col("at").alias("place"), "applies_to", F.col("words")[0].alias("word"), "pattern", F.col("window").alias("wide"))


def page_addresses(spark, sf_dir):
    """Host, port and last part of the path of each page's url."""
    authority = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    address = F.when(F.col("page_id") % 3 == 0, F.concat(authority, F.lit(":8443"))).otherwise(authority)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return _table(spark, sf_dir, "pages").select("page_id", split_address(address).alias("a"), base_name(path).alias("base")).select("page_id", "a.host", "a.port", "base")


QUERIES = {
    f.__name__: f
    for f in (
        classify_documents, classify_conversations, prefix_candidates, severity_guard, status_counts, config_violations, scan_large, regex_matches, prefix_hits, dictionary_counts, windowed_matches, match_entropy, hotword_context, exclusion_eval, score_matches, scan_documents, scan_conversations, scan_dedup, scan_by_source, scan_by_lang, blocked_counters,
        resolve_page_hosts, dns_verdicts, tier2_hosts, rule_precedence, override_merge, accuracy_report, accuracy_by_lang, pattern_fp, pattern_fn, report_examples, corpus_categories, accuracy_regression, centroids, prefilter_verdicts, linear_head, disambiguator_scores, scan_with_ml,
        tamper_edges, counter_deltas, last_notifications, id_rollback, byte_budget, enforcement_decisions, risky_extensions, manifest_delta, clipboard_fingerprints, rate_limit, clipboard_throttle,
        streamed_edges, streamed_rate_limit, streamed_throttle, streamed_hello, cached_scans, cache_counts, profile_snapshots, framed_conversations, conversation_macs, text_second_opinion, planted_recall, sample_corpus, sql_scan, sql_columns, profile_checks, exclusion_merge, page_addresses,
    )
}

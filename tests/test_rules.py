import json
import os

import pytest
from pyspark.sql import functions as F

from riskweave.operators import domains, ordered, policy, report, vectors
from riskweave.sources import readers, sinks


def test_lookup(spark):
    rules = domains.rule_table(spark, [[("A", ".deep.com"), ("B", "bare.ai"), ("C", "exact.deep.com")], [("D", "bare.ai")]])
    hosts = spark.createDataFrame([(h,) for h in ("deep.com", "x.deep.com", "y.x.deep.com", "bare.ai", "sub.bare.ai", "EXACT.deep.com.", None)], "host string")
    got = {r.host: r.category for r in domains.resolved(hosts, rules).collect()}
    assert got == {"deep.com": "A", "x.deep.com": "A", "y.x.deep.com": "A", "bare.ai": "B", "sub.bare.ai": None, "EXACT.deep.com.": "C"}


def test_missing_policy_denies(spark):
    rules = domains.rule_table(spark, [[("A", "a.com"), ("B", "b.com")]])
    policies = spark.createDataFrame([("A", "allow")], "category string, action string")
    hosts = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "host string")
    assert {r.host: (r.action, r.rcode) for r in domains.decided(hosts, rules, policies).collect()} == {"a.com": ("allow", "FORWARD"), "b.com": ("deny", "NXDOMAIN"), "c.com": ("allow", "FORWARD")}


def test_report(spark):
    rows = spark.createDataFrame([(1, True, True, "p", "p"), (2, True, False, "", "p"), (3, False, True, "q", None), (4, False, False, "", None)], "sample_id long, expected boolean, blocked boolean, pattern_name string, expected_pattern string")
    r = report.accuracy(rows).head()
    assert (r.tp, r.fn, r.fp, r.tn, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert report.false_positives(rows).head().example_ids == [3]
    assert tuple(report.false_negatives(rows).head()) == ("p", 1, 2, 0.5, [2])  # of those that expect p, found or missed
    many = spark.createDataFrame([(i, False, True, "q" if i else "r", None) for i in range(8)], rows.schema)
    assert [(r.pattern, r.fp_count, r.total_negatives, r.fp_rate, r.example_ids) for r in report.false_positives(many).collect()] == [("q", 7, 8, 0.875, [1, 2, 3, 4, 5]), ("r", 1, 8, 0.125, [0])]
    kinds = report.by_category_of(many, spark.createDataFrame([("q", "c")], "pattern string, corpus_category string"))
    assert {(r.pattern_name, r.corpus_category) for r in kinds.collect()} == {("q", "c"), ("r", "other_generic")}
    assert report.accuracy(rows.limit(0)).head().f1 == 0.0


def test_token_bucket_and_throttle(spark):
    rows = spark.createDataFrame([("a", float(t), i, m) for i, (t, m) in enumerate([(0, "x"), (0, "x"), (0, "y"), (1, "y"), (3, "x")])], "k string, s double, i long, m string")
    assert [r.allowed for r in ordered.token_bucket(rows, "k", "s", "i", 1.0, 2.0).orderBy("i").collect()] == [True, True, False, True, True]
    nobody = spark.createDataFrame([(None, 0.0, i, "x") for i in range(5)], rows.schema)
    assert [r.allowed for r in ordered.token_bucket(nobody, "k", "s", "i", 1.0, 2.0).orderBy("i").collect()] == [True, True, False, False, False]
    assert [r.accepted for r in ordered.throttled(nobody, "k", "s", "i", "m").orderBy("i").collect()] == [True, False, False, False, False]
    assert all(r.allowed for r in ordered.token_bucket(nobody, "k", "s", "i", 0.0, 2.0).collect())
    got = [r.accepted for r in ordered.throttled(rows, "k", "s", "i", "m").orderBy("i").collect()]
    assert got == [True, False, False, False, False]


def test_joined_files(spark):
    rows = spark.createDataFrame([("u", 1, "abc"), ("u", 2, "defg"), ("u", 3, "h")], "k string, o int, t string")
    r = ordered.joined_files(rows, "k", "o", "t", 5).head()
    assert (r.text, r.truncated) == ("abc\nde", True)


def test_enforcement_and_validation(spark):
    rows = spark.createDataFrame([("managed", 2 << 20, None, None, None), ("team", 10, None, None, None), ("personal", 10, True, "p", 4), ("personal", 10, False, "", 0)], "mode string, size long, blocked boolean, pattern_name string, score long")
    assert [(r.decision, r.effective_pattern) for r in policy.enforced(rows).collect()] == [("block", "policy:oversize"), ("warn", "policy:agent-unavailable"), ("block", "p"), ("allow", "")]
    config = spark.createDataFrame([("n", "managed", ["  "], " ", True, None), ("t", "team", [None, "x"], "/t", True, None), ("p", "personal", None, None, None, None), ("m", "managed", ["x"], "/t", False, "/p")], "name string, mode string, allowed_extension_ids array<string>, api_token_path string, api_token_required boolean, profile_path string")
    keys = ["bridge_mac_required", "profile_public_key", "rule_update_public_key"]
    assert {r.name: r.violations for r in policy.violations(config).collect()} == {"n": ["allowed_extension_ids", "api_token_path", *keys, "profile_path or profile_url"], "t": [], "p": [], "m": ["api_token_required", *keys]}


def test_profile(spark, tmp_path):
    config = spark.createDataFrame([(1, 2, 3, 4, 2, 1, -2, -3, 1)], ", ".join(f"{k} int" for k in policy.DLP_KEYS))
    policies = spark.createDataFrame([("Social", "allow"), ("News", "deny")], "category string, action string")
    change = lambda v: spark.createDataFrame([v], "threshold_high int, threshold_low int, entropy_penalty int")
    new, numbers = policy.applied_profile(policies, config, spark.createDataFrame([("News", "allow")], policies.schema), change((5, 0, None)))
    assert {tuple(r) for r in new.collect()} == {("Social", "allow"), ("News", "allow")} and list(numbers.head()) == [1, 5, 3, 4, 2, 1, -2, -3, 1]
    with pytest.raises(ValueError, match="range"):
        policy.applied_profile(policies, config, policies, change((-5, 0, None)))
    with pytest.raises(ValueError, match="category"):
        policy.applied_profile(policies, config, spark.createDataFrame([("Nonsense", "allow")], policies.schema), change((5, 0, None)))
    sinks.replace_config(numbers, str(tmp_path / "c"))
    assert sinks.read_config(spark, str(tmp_path / "c")).head().threshold_high == 5
    with pytest.raises(ValueError, match="valid"):
        sinks.replace_config(numbers.withColumn("exclusion_penalty", F.lit(101)), str(tmp_path / "c"))
    sinks.replaced(new, str(tmp_path / "p"))
    assert [r.category for r in sinks.read_policies(spark, str(tmp_path / "p")).collect()] == ["News", "Social"]


def test_replacement_cut_off(spark, tmp_path):
    """Whatever step a crash hits, the old table or the whole new one is there afterwards."""
    path = str(tmp_path / "t")
    table = lambda n, where: spark.createDataFrame([(n,)], "n long").write.parquet(where)
    read = lambda: [r.n for r in spark.read.parquet(path).collect()] if sinks.recovered(spark, path) else None
    assert read() is None
    table(1, path + ".new")
    os.remove(path + ".new/_SUCCESS")
    assert read() is None  # not written whole
    open(path + ".new/_SUCCESS", "w").close()
    assert read() == [1]
    os.rename(path, path + ".old")
    assert read() == [1]
    table(2, path + ".new")
    os.rename(path, path + ".old")  # between the two moves
    assert read() == [2] and not os.path.exists(path + ".old")
    sinks.replaced(spark.read.parquet(path).select(F.col("n") + 1), path)
    assert [r[0] for r in spark.read.parquet(path).collect()] == [3]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.2]), (3, 1, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    head = vectors.linear_head(rows, F.col("label") == 0).head()
    assert (head.tp_right, head.tn_right) == (2, 1)
    got = vectors.prefilter(rows, [1.0, 0.0], [0.0, 1.0]).orderBy("vec_id").collect()
    assert [r.verdict for r in got] == ["unknown", "unknown", "likely_benign"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"patterns": [{"name": "n", "regex": "[0-9]+", "severity": "high", "score_weight": 2, "hotwords": ["a"]}]}))
    p = readers.as_patterns(readers.read_patterns(spark, str(tmp_path / "p.json")))[0]
    assert (p.name, p.category, p.hotwords) == ("n", "uncategorized", ("a",))
    (tmp_path / "ai_allowed.txt").write_text("# c\n.Example.com # x\n\nb.org\n")
    got = {(r.category, r.host, r.is_wildcard) for r in readers.read_domains(spark, [str(tmp_path / "ai_allowed.txt")]).collect()}
    assert got == {("AI Allowed", "example.com", True), ("AI Allowed", "b.org", False)}
    html = '<p><textarea name=a>one</textarea><input type="text" value="two"><input type="password" value="no">'
    assert spark.createDataFrame([(html,)], "h string").select(readers.form_text(F.col("h"))).head()[0] == "one\ntwo"
    frame = (5).to_bytes(4, "little") + b'{"a"}'
    got = readers.frames(spark.createDataFrame([(bytearray(frame),), (bytearray(b"\0\0\0\0"),)], "body binary")).collect()
    assert [(r["size"], r["json"]) for r in got] == [(5, '{"a"}'), (0, None)]
    path = str(tmp_path / "counters")
    sinks.replaced(sinks.zero_counters(spark), path)
    sinks.replaced(sinks.added(spark.read.parquet(path), spark.createDataFrame([(1, 2, 3, 4, 5)], ", ".join(f"{c} long" for c in sinks.COUNTERS))), path)
    assert list(spark.read.parquet(path).head()) == [1, 2, 3, 4, 5]


def test_streaming_counters(spark, tmp_path):
    from riskweave.streaming import jobs

    spark.createDataFrame([(True,), (False,), (True,)], "blocked boolean").write.parquet(str(tmp_path / "in"))
    counters = lambda b: b.agg(F.lit(0).cast("long").alias("dns_queries"), F.lit(0).cast("long").alias("dns_blocks"), F.count("*").alias("dlp_scans"), F.count_if(F.col("blocked")).alias("dlp_blocks"), F.lit(0).cast("long").alias("tamper_events"))
    flush = jobs.flush_into(str(tmp_path / "sum"), counters)
    stream = spark.readStream.schema("blocked boolean").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(flush).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    os.rename(tmp_path / "sum", tmp_path / "sum.old")  # cut off while it was replaced
    flush(spark.read.parquet(str(tmp_path / "in")), 0)  # the same batch again adds nothing
    r = spark.read.parquet(str(tmp_path / "sum")).head()
    assert (r.dlp_scans, r.dlp_blocks) == (3, 2)


def test_answers_for_repeated_content(spark, tmp_path):
    from riskweave.streaming import jobs

    seen, now, rules = [], [0.0], ["1"]

    def scan(rows):
        seen.append(sorted(r.text for r in rows.collect()))
        return rows.select("content_id", F.col("text").contains("bad").alias("blocked"))

    answer = jobs.answering(str(tmp_path / "cache"), str(tmp_path / "out"), scan, 5.0, lambda: rules[0], lambda: now[0])
    batch = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "content_id long, text string")
    answer(batch("bad", "ok", "bad"), 0)
    now[0] = 4.0
    answer(batch("ok", "new"), 1)
    now[0] = 7.0
    answer(batch("ok", "new"), 2)  # the first is stale, the second is held
    rules[0] = "2"
    answer(batch("new"), 3)  # other rules
    assert seen == [["bad", "ok"], ["new"], ["ok"], ["new"]]
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("batch").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")).orderBy("batch")
    assert [tuple(r) for r in got.collect()] == [(0, 3, 2), (1, 2, 0), (2, 2, 0), (3, 1, 0)]


@pytest.fixture
def ending(spark):
    """Streams with a time-out on keys run empty batches for ever unless these are turned off."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_keyed_streams(spark, tmp_path, ending):
    from riskweave.streaming import jobs

    rows = [("a", 0.0, True, "x"), ("a", 1.0, False, "x"), ("a", 2.0, False, "y"), ("a", 4.0, None, "y"), ("a", 5.0, False, "z"), ("b", 0.0, False, "x")]
    spark.createDataFrame(rows, "k string, s double, ok boolean, m string").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, f):
        stream = spark.readStream.schema("k string, s double, ok boolean, m string").parquet(str(tmp_path / "in"))
        f(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}.cp")).trigger(availableNow=True).start().awaitTermination(120)
        return [(r.k, r.s) for r in spark.read.parquet(str(tmp_path / name)).where(F.col(name)).orderBy("k", "s").collect()]

    assert run("edge", lambda x: jobs.tamper_edges(x, "k", "s", "ok")) == [("a", 1.0), ("a", 5.0), ("b", 0.0)]
    assert run("accepted", lambda x: jobs.throttled(x, "k", "s", "m")) == [("a", 0.0), ("a", 2.0), ("a", 5.0), ("b", 0.0)]
    assert run("hello", lambda x: jobs.hello_once(x, "k", "s")) == [("a", 0.0), ("b", 0.0)]
    assert run("allowed", lambda x: jobs.limited(x, "k", "s", 0.5, 1.0)) == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 0.0)]


def test_first_of(spark):
    rows = spark.createDataFrame([("f", 1, 2, "late"), ("f", 1, 1, "first"), (None, 1, 3, "n"), (None, 1, 4, "m")], "name string, size int, o int, t string")
    assert sorted(r.t for r in ordered.first_of(rows, ["name", "size"], ["o"]).collect()) == ["first", "n"]


def test_form_texts(spark):
    html = """<INPUT value='it&#39;s' TYPE=search><input name=q value=plain><input placeholder="a value=no > b" type=text value="x &amp;lt; y">
    <input type=hidden value=no><input type="password" value="no"><input type="text"><input data-value=no type=url value="http://a"/>
    <textarea name="t">\nfirst\n<b> "quoted'</textarea><textarea></textarea><input type=nonsense value=kept>"""
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(readers.form_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["it's\nplain\nx &lt; y\nhttp://a\nfirst\n<b> \"quoted'\nkept", "", ""]


def test_request_bodies(spark):
    rows = [("text", "as is", None, None, None), ("params", None, None, ["a b", "c"], ["1&2", "é"]), ("form", None, None, ["a b"], ["x y"]), ("bytes", None, "añ".encode(), None, None), ("stream", "no", b"no", ["n"], ["o"]), (None, None, None, None, None), ("text", None, None, None, None)]
    got = spark.createDataFrame(rows, "kind string, text string, raw binary, names array<string>, vals array<string>").select(readers.body_text(*map(F.col, ("kind", "text", "raw", "names", "vals")), cap=2)).collect()
    assert [r[0] for r in got] == ["as is", "a+b=1%262&c=%C3%A9", "a%20b=x%20y", "a\ufffd", "", "", ""]
    assert spark.createDataFrame([("añ",)], "t string").select(readers.first_bytes(F.col("t"), 2)).head()[0] == "a\ufffd"

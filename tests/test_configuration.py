import os

from pyspark.sql import functions as F

from riskweave.functions.text import base_name, split_address
from riskweave.operators import domains, ordered, policy
from riskweave.sources import readers, sinks


def test_overrides_are_rules_of_their_own_categories(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# note\n.Good.example.com\nplain.example.org\n\n.\n")
    (tmp_path / "block.txt").write_text("bad.example.com\n")
    rules = readers.override_rules(*(readers.read_override(spark, str(tmp_path / f)) for f in ("allow.txt", "block.txt")), 5)
    got = {(r.source_ord, r.category, r.host, r.is_wildcard) for r in rules.collect()}
    assert got == {(5, "allow_admin", "good.example.com", True), (5, "allow_admin", "plain.example.org", False), (6, "block_admin", "bad.example.com", False)}
    base = domains.rule_table(spark, [[("Social", ".example.com"), ("News", "bad.example.com")]])
    both = base.unionByName(rules.withColumn("line_ord", F.col("line_ord").cast("int")))
    hosts = spark.createDataFrame([("x.good.example.com",), ("bad.example.com",)], "host string")
    assert {r.host: r.category for r in domains.resolved(hosts, both).collect()} == {"x.good.example.com": "allow_admin", "bad.example.com": "News"}


def test_an_override_list_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "allow.txt")
    for entries in (["b", "a", "b"], ["c"]):
        sinks.write_override(spark.createDataFrame([(e,) for e in entries], "entry string"), path)
        assert [r.value for r in spark.read.text(path).collect()] == sorted(set(entries))
    os.rename(path, path + ".old")  # a crash between the two moves
    assert sinks.recovered(spark, path) and [r.value for r in spark.read.text(path).collect()] == ["c"]


def test_profiles(spark):
    kind = "name string, categories map<string,string>, dlp_thresholds struct<critical:int,high:int,medium:int,low:int>"
    rows = [("fine", {"News": "deny", "Social": "allow_with_dlp"}, (0, 1, 2, 3)), (" ", {"b": "x", "a": None, "c": "allow"}, None), (None, None, (1, None, -1, 2)), ("n", {}, None)]
    got = [r.violations for r in policy.profile_violations(spark.createDataFrame(rows, kind)).collect()]
    assert got == [[], ["name", "action of a", "action of b"], ["name", "dlp_thresholds"], []]


def test_rules_are_merged_in_place(spark):
    kind = "at int, name string, words array<string>, window int"
    base = spark.createDataFrame([(1, "a", ["x"], 1), (2, None, None, 2), (3, "a", ["x"], 3), (4, "b", [], 4)], kind)
    over = spark.createDataFrame([(7, "new", ["x"], 7), (1, "a", ["x"], 10), (2, None, None, 20), (5, "a", ["y"], 50), (9, "new", ["x"], 90), (6, "b", None, 60)], kind)
    got = [tuple(r) for r in policy.merged_rules(base, over, ["name", "words"], "at").orderBy("at").collect()]
    assert got == [(0, "a", ["x"], 1), (1, None, None, 20), (2, "a", ["x"], 10), (3, "b", [], 4), (4, "a", ["y"], 50), (5, "b", None, 60), (6, "new", ["x"], 90)]
    assert policy.merged_rules(base, over.limit(0), ["name", "words"], "at").count() == 4
    assert policy.merged_rules(base.limit(0), over, ["name", "words"], "at").count() == 5


def test_registered_categories(spark):
    base = spark.createDataFrame([("News", "deny")], "category string, action string")
    change = spark.createDataFrame([("My Own", "allow")], base.schema)
    names = [spark.createDataFrame([(x,) for x in v], "category string") for v in ([" My Own ", ""], ["Other", "My Own", None])]
    assert sorted(r.category for r in policy.registered(*names).collect()) == ["My Own", "Other"]
    got = policy.with_policy(base, change, names=policy.registered(*names))
    assert {tuple(r) for r in got.collect()} == {("News", "deny"), ("My Own", "allow")}
    try:
        policy.with_policy(base, change)
    except ValueError:
        return
    raise AssertionError("an unknown category was taken")


def test_heads_are_read(spark, tmp_path):
    (tmp_path / "h.json").write_text('{\n "weights": [0.5, -1],\n "bias": 0.25\n}')
    row = readers.read_head(spark, str(tmp_path / "h.json")).head()
    assert (row.weights, row.bias) == ([0.5, -1.0], 0.25)
    (tmp_path / "n.json").write_text('{"bias": 1}')
    try:
        readers.read_head(spark, str(tmp_path / "n.json")).collect()
    except Exception as e:
        assert "without weights" in str(e)
        return
    raise AssertionError("a head without weights was read")


def test_addresses_and_base_names(spark):
    rows = spark.createDataFrame([("127.0.0.1:53", "/a/b.txt"), ("host", "a//"), ("[::1]:80", ""), ("", "///"), ("a:b:c", "x"), (None, None)], "a string, p string")
    got = rows.select(split_address(F.col("a")).alias("a"), base_name(F.col("p")).alias("b")).select("a.host", "a.port", "b").collect()
    assert [tuple(r) for r in got[:5]] == [("127.0.0.1", "53", "b.txt"), ("host", "", "a"), ("[::1]", "80", "."), ("", "", "/"), ("a:b", "c", "x")]
    assert got[5].host is None and got[5].b is None


def test_columns_of_the_callers_names_stay(spark):
    events = spark.createDataFrame([("a", 1, 1, True, 7), ("a", 2, 2, False, 8), ("a", 3, 3, None, 9)], "k string, ts int, n int, ok boolean, was_ok int")
    got = ordered.bad_edges(events, "k", "ts", "ok", "n").collect()
    assert [(r.n, r.was_ok) for r in got] == [(2, 8)]
    rules = domains.rule_table(spark, [[("News", "a.org")], [("Social", "a.org")]]).withColumn("k", F.lit("mine")).withColumn("rule", F.lit(1))
    (row,) = domains.effective(rules).collect()
    assert (row.category, row.k, row.rule) == ("News", "mine", 1)
    (row,) = domains.effective(rules, overrides_first=True).collect()
    assert row.category == "Social"

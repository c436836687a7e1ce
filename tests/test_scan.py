import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.functions import text as T
from riskweave.operators import scan
from riskweave.plans.packs import Exclusion, Pattern, ScanConfig

SAMPLES = ["", None, "plain words", "import os\nimport sys\n", '{"a": 1}', "a,b\nc,d\ne,f", "a=1\nb=2\nc=3", "a,b\nplain\nc,d,e\nf,g"]
KINDS = ["natural", "natural", "natural", "code", "structured", "structured", "credentials", "natural"]


def test_content_types(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")
    assert [r.k for r in df.orderBy("i").select(T.content_type(F.col("t")).alias("k")).collect()] == KINDS


def test_content_types_as_expected(spark):
    """Expected classes written out: sources, structured data, settings, prose."""
    cases = [
        ("code", 'package main\n\nimport "fmt"\nimport "os"\n\nfunc main() {\n\tfmt.Println(os.Args)\n}'),
        ("code", "from collections import defaultdict\ndef foo(x):\n    return x\n\nclass Bar:\n    pass"),
        ("code", "fn main() {\n}\nfn other(x: u8) {\n}"),
        ("natural", "return home\nreturn soon\nif (ever) you can"),
        ("structured", '{"user": "alice", "id": 42, "tags": ["a", "b"]}'),
        ("structured", "name,age,city\nalice,30,nyc\nbob,25,sfo\ncarol,40,la\ndan,35,bos"),
        ("credentials", "AWS_ACCESS_KEY_ID=AKIA1234\nAWS_SECRET_ACCESS_KEY=secret\nDATABASE_URL=postgres://user:pw@host\nAPI_TOKEN=abcdef"),
        ("credentials", "key=one two\nother: x\nthird=y z"),
        ("natural", "This is a paragraph of plain text with many spaces and ordinary words."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "i int, t string")
    assert [r.k for r in df.orderBy("i").select(T.content_type(F.col("t")).alias("k")).collect()] == [k for k, _ in cases]


def test_many_matches_and_windows(spark):
    """Offsets and the bytes around each of many matches, across blocks."""
    text = "é" + " ".join(f"x{i:03d}" for i in range(400))
    p = Pattern("n", "x[0-9]{3}", severity="critical", hotwords=("h",), hotword_window=7)
    b = text.encode()
    want = {(m.start(), m.end(), b[max(0, m.start() - 7) : m.start()], b[m.end() : m.end() + 7]) for m in re.finditer(rb"x[0-9]{3}", b)}
    got = scan.matches(spark.createDataFrame([(1, text), (2, ""), (3, None)], "content_id long, text string"), [p]).collect()
    assert {(r.start, r.stop, bytes(r.before), bytes(r.after)) for r in got} == want and len(got) == 400


@pytest.mark.parametrize("value", ["", "aaaa", "abcd", "né€a"])
def test_entropy(spark, value):
    b = value.encode()
    want = -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values()) if b else 0.0
    got = spark.createDataFrame([(value,)], "v string").select(T.entropy(F.col("v"))).head()[0]
    assert abs(got - want) < 1e-9


def test_offsets_are_bytes(spark):
    p = Pattern("n", "[0-9]{3}", severity="critical")
    text = "é123 € 456 x 789"
    got = {(r.start, r.value) for r in scan.matches(spark.createDataFrame([(1, text)], "content_id long, text string"), [p]).collect()}
    assert got == {(m.start(), m[0].decode()) for m in re.finditer(rb"[0-9]{3}", text.encode())}


def verdict(spark, text, patterns, rules=(), cfg=None):
    rows = scan.scan(spark.createDataFrame([(1, text)], "content_id long, text string"), patterns, list(rules), cfg).collect()
    return (rows[0].blocked, rows[0].pattern_name, rows[0].score)


def test_gates_and_scores(spark):
    key = Pattern("key", "sk_[a-z0-9]{8}", "SK_", "high", 2, hotwords=("secret",), hotword_window=10)
    assert verdict(spark, "sk_abcd1234", [key]) == (True, "key", 2)
    assert verdict(spark, "the secret sk_abcd1234", [key]) == (True, "key", 4)
    assert verdict(spark, "secret, far away from it: sk_abcd1234", [key]) == (True, "key", 2)
    assert verdict(spark, "nothing", [key]) == (False, "", 0)
    assert verdict(spark, None, [key]) == (False, "", 0)
    need = Pattern("key", "sk_[a-z0-9]{8}", "sk_", "high", 2, hotwords=("secret",), hotword_window=10, require_hotword=True)
    assert verdict(spark, "sk_abcd1234", [need])[0] is False
    bulk = Pattern("ip", r"[0-9]+\.[0-9]+", "", "high", 2, min_matches=3)
    assert verdict(spark, "1.1 2.2", [bulk])[0] is False
    assert verdict(spark, "1.1 2.2 3.3", [bulk]) == (True, "ip", 4)
    many = " ".join(f"{i}.{i}" for i in range(20))
    assert verdict(spark, many, [bulk])[2] == 7  # five more matches count at most


def test_exclusions(spark):
    p = Pattern("mail", r"[a-z]+@[a-z.]+", "@", "critical", 2)
    assert verdict(spark, "a@example.com", [p], [Exclusion("mail", "regex", pattern="example", suppress=True)])[0] is False
    assert verdict(spark, "a@example.com", [p], [Exclusion("MAIL", "dictionary", ("a@EXAMPLE.com",), match_type="exact")])[0] is False
    assert verdict(spark, "sample a@example.com", [p], [Exclusion("*", "dictionary", ("sample",))])[0] is False
    assert verdict(spark, "a@example.com", [p], [Exclusion("other", "regex", pattern="a", suppress=True)])[0] is True


def test_words_of_rules_are_trimmed(spark):
    p = Pattern("mail", r"[a-z]+@[a-z.]+", "@", "critical", 2)
    blank = Pattern("mail", r"[a-z]+@[a-z.]+", "@", "critical", 2, hotwords=(" ", ""), hotword_window=9)
    near = Exclusion("*", "dictionary", (" sample ",))
    assert verdict(spark, "x a@example.com", [blank])[2] == 2  # a blank word is near nothing
    assert verdict(spark, "x a@example.com", [p], [Exclusion("*", "dictionary", ("", " "))])[2] == 2
    assert verdict(spark, "a sample, a@example.com", [p], [near])[0] is False
    assert verdict(spark, "sample@example.com", [p], [near])[0] is True  # a word within the match itself
    # only the first place of the value is left out, here the one before the match
    assert verdict(spark, "sample@b.sample@b.c sample@b", [p], [near])[0] is False
    assert verdict(spark, " a@example.com", [p], [Exclusion("mail", "dictionary", (" a@example.com ",), match_type="exact")])[0] is False


def test_large_contents_keep_severe_patterns_only(spark):
    low, high = Pattern("low", "xx1", "xx1", "low", 5), Pattern("high", "xx2", "xx2", "critical", 5)
    text = "xx1 xx2 " + "." * 200
    assert verdict(spark, text, [low, high], cfg=ScanConfig(large=100))[1] == "high"
    assert verdict(spark, text, [low, high], cfg=ScanConfig(large=0))[1] == "high"
    assert verdict(spark, "xx1", [low, high], cfg=ScanConfig(large=100))[1] == "low"


def test_names(spark):
    row = spark.createDataFrame([("C:\\a\\Setup.EXE", ".env", " Https://A.Example.com/x?y ", "[::1]:80", "10.1.2.3", "ai_chat_dlp.txt", "Foo  Bar_baz!", "a b~c")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = row.select(T.extension(F.col("a")), T.extension(F.col("b")), T.normal_domain(F.col("c")), T.strip_port(F.col("d")), T.is_internal_ip(F.col("e")), T.category_name(F.col("f")), T.slug(F.col("g")), T.url_component(F.col("h"))).head()
    assert list(got) == ["exe", "", "a.example.com", "::1", True, "AI Chat DLP", "foo-bar-baz", "a%20b~c"]


def test_fingerprint(spark):
    text = "héllo 😀"
    h, units = 2166136261, text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2])) * 16777619 & 0xFFFFFFFF
    got = spark.createDataFrame([(text,)], "t string").select(T.fingerprint(F.col("t"))).head()[0]
    assert got == f"{len(units) // 2}:{h:x}"


def test_internal_addresses(spark):
    inside = ["::1", "::", "0:0:0:0:0:0:0:1", "FE80::1%eth0", "fd00::5", "ff02::1", "::ffff:10.0.0.1", "127.0.0.1", "172.31.0.1"]
    outside = ["2001:db8::1", "::ffff:8.8.8.8", "8.8.8.8", "172.32.0.1", "1::1", "host", ""]
    df = spark.createDataFrame([(x,) for x in [*inside, *outside]], "ip string")
    assert {r.ip for r in df.where(T.is_internal_ip(F.col("ip"))).collect()} == set(inside)

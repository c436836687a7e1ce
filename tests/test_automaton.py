import random
import re

import numpy as np
import pytest

from riskweave.operators import automaton, scan
from riskweave.plans.packs import Pattern, ScanConfig

SCHEMA = "content_id long, text string"


def places(text, word):
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + len(word))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_occurrences_against_find(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", "é".encode(), b" "]
    word = lambda n: b"".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = sorted({word(5) for _ in range(30)} | {b"aa", b"aba", b"x" * 600})
    texts = [word(400) if i % 5 else b"" for i in range(40)] + [b"x" * 1500, b"ab" * 5000]
    got = list(zip(*(x.tolist() for x in automaton.Automaton(words).occurrences(texts)), strict=True))
    assert got == [(t, w, at) for t, text in enumerate(texts) for w, x in enumerate(words) for at in places(text, x)]


def test_no_words_and_no_texts():
    assert [x.tolist() for x in automaton.Automaton([]).occurrences([b"abc"])] == [[], [], []]
    assert [x.tolist() for x in automaton.Automaton([b"a"]).occurrences([])] == [[], [], []]
    with pytest.raises(ValueError):
        automaton.Automaton([b"a", b"a"])
    with pytest.raises(ValueError):
        automaton.Automaton([b"a" * (automaton.MOST + 1)])


def test_words_do_not_meet_across_texts():
    assert automaton.Automaton([b"ab"]).occurrences([b"a", b"b", b"ab"])[0].tolist() == [2]


def test_prefixes_that_fold_alike_share_one(spark):
    rows = spark.createDataFrame([(1, "Key key KEY é key"), (2, None), (3, ""), (4, "nothing"), (1, "key")], SCHEMA)
    got = automaton.prefix_hits(rows, [Pattern("one", "x", "KEY"), Pattern("two", "y", "key"), Pattern("none", "z")])
    assert sorted(map(tuple, got.collect())) == [(1, "key", 0), (1, "key", 0), (1, "key", 4), (1, "key", 8), (1, "key", 15)]


def test_plan_has_one_size_for_any_number_of_patterns(spark):
    rows = spark.createDataFrame([(i, f"text k{i} value{i}=abc") for i in range(50)], SCHEMA)
    size = lambda n: len(scan.matches(rows, [Pattern(f"p{i}", f"value{i}=[a-z]+", f"value{i}=") for i in range(n)])._jdf.queryExecution().executedPlan().toString())
    assert size(10) == size(1000)
    many = [Pattern(f"p{i}", f"value{i}=[a-z]+", f"value{i}=") for i in range(800)]
    assert sorted((r.content_id, r.pattern) for r in scan.matches(rows, many).collect()) == sorted((i, f"p{i}") for i in range(50))


def test_a_dictionary_in_several_passes(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma alpha")], SCHEMA)
    got = automaton.dictionary_hits(rows, ["Alpha", "beta", "gamma", "", "delta"], most=6)
    assert sorted(map(tuple, got.collect())) == [(1, "alpha", 0), (1, "alpha", 17), (1, "beta", 6), (1, "gamma", 11)]
    assert automaton.dictionary_hits(rows, []).count() == 0


def test_islands():
    assert automaton.islands(np.array([10, 50, 300]), 400, 30) == [(0, 80), (270, 330)]
    assert automaton.islands(np.array([0, 60]), 1000, 30) == [(0, 90)]
    assert automaton.islands(np.array([], np.int64), 10) == []


def told(spark, text, pattern, windowed):
    found = scan.matches(spark.createDataFrame([(1, text)], SCHEMA), [pattern], ScanConfig(windowed=windowed, large=0))
    return sorted((r.start, r.stop, r.value, r.num_matches) for r in found.collect())


def test_windows_and_whole_texts(spark):
    """Windows that overlap give each match once; what lies away from the prefix is found in whole texts only."""
    pattern = Pattern("key", r"k=[a-z]+|far [0-9]+", "k=")
    text = "é" * 700 + "k=one " + "x" * 900 + " k=two far 1 " + "y" * 3000 + " far 2 " + "z" * 3000 + " far 3 k=three"
    raw = text.encode()
    whole = [(m.start(), m.end(), m[0].decode(), 6) for m in re.finditer(pattern.regex.encode(), raw)]
    assert told(spark, text, pattern, False) == whole
    near = told(spark, text, pattern, True)
    assert [x[:3] for x in near] == [x[:3] for x in whole if x[2] != "far 2"] and {x[3] for x in near} == {5}
    short = text[:100] + " far 7 k=a"
    assert told(spark, short, pattern, True) == told(spark, short, pattern, False)


def test_a_window_cuts_long_matches(spark):
    pattern = Pattern("long", "k=a+", "k=")
    text = "b" * 100 + "k=" + "a" * 5000
    assert [x[:2] for x in told(spark, text, pattern, False)] == [(100, 5102)]
    assert [x[:2] for x in told(spark, text, pattern, True)] == [(100, 100 + automaton.WINDOW)]


def test_windows_end_between_characters(spark):
    pattern = Pattern("any", "k=é+", "k=")
    text = "x" + "é" * 600 + "k=" + "é" * 2000
    (start, stop, value, n), = told(spark, text, pattern, True)
    assert (start, n) == (1201, 1) and stop == start + len(value.encode()) <= start + automaton.WINDOW


def test_patterns_without_prefix_and_with_classes(spark):
    rows = spark.createDataFrame([(1, "import a\nimport b\nid 12٣"), (2, None)], SCHEMA)
    packs = [Pattern("number", r"\d+"), Pattern("code", "id", "ID", content_types=("code",)), Pattern("prose", "id", "id", content_types=("natural",))]
    assert sorted((r.content_id, r.pattern, r.value) for r in scan.matches(rows, packs).collect()) == [(1, "code", "id"), (1, "number", "12")]
    with pytest.raises(re.error):
        scan.matches(rows, [Pattern("bad", "(")])


def test_bytes_that_are_no_utf8_keep_places(spark):
    rules = automaton.Rules([Pattern("p", "k=[a-z]+", "k=")], ScanConfig(), (), 0, False)
    text = b"\xff\xfe k=one \xc3 k=two"
    ((_, _, ranges),) = rules.found([text], ["natural"], rules.regexes())
    assert [text[a:b] for a, b in ranges] == [b"k=one", b"k=two"]
    assert list(scan.Scorer(rules.patterns, [], ScanConfig(thresholds={"low": 1, "medium": 1})).verdicts([text, b"\xff"], ["natural"] * 2)) == [(True, "p", 2), (False, "", 0)]

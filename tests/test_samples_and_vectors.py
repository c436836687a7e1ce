import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave import sqlfunctions
from riskweave.functions.text import entropy
from riskweave.operators import embed, samples, scan, vectors
from riskweave.plans.packs import EXCLUSIONS, PATTERNS, Exclusion, Pattern, ScanConfig

SCHEMA = "content_id long, text string"
ODD = ["", None, " \n", "É word é", "same same same", "x" * 3000, "a b " * 500]


class Counting:
    """A model whose hidden vectors tell the token and its place in the sequence."""

    dim = 3

    def tokens(self, text):
        return [len(w) for w in text.split()]

    def hidden(self, ids, mask):
        assert ids.shape == mask.shape and (ids[mask == 0] == 0).all()
        return np.stack([ids, np.ones_like(ids), ids * 0 + 0.5], axis=2).astype(float)


@pytest.mark.parametrize("length, places", [(128, 1 << 14), (3, 7), (1, 1)])
def test_pooling_by_mask(length, places):
    """Whatever the batches and their padding, a text's vector is the mean over its own tokens."""
    texts = ["a bb ccc dddd", "", "zz " * 50, "q", None]
    got, n = embed.vectors(Counting(), [t or "" for t in texts], length, places)
    for row, count, text in zip(got, n, texts, strict=True):
        words = (text or "").split()
        assert count == len(words)
        mean = np.mean([[len(w), 1.0, 0.5] for w in words], axis=0) if words else np.zeros(3)
        assert np.allclose(row, mean / max(np.linalg.norm(mean), 1e-12))


def test_pooling_agrees_with_the_column_function(spark):
    rng = np.random.default_rng(3)
    hidden, mask = rng.normal(size=(6, 4)), [1, 0, 1, 1, 0, 1]
    row = spark.createDataFrame([(hidden.tolist(), mask)], "v array<array<double>>, m array<int>")
    got = row.select(vectors.unit(vectors.pooled(F.col("v"), F.col("m")))).head()[0]
    assert np.allclose(got, embed.unit(hidden[np.array(mask) == 1].mean(axis=0)))


def test_embedded_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "same same same"])], SCHEMA)
    got = {r.content_id: r for r in embed.embedded(rows.repartition(3)).collect()}
    assert len(got) == 8 and got[4].embedding == got[7].embedding
    for i in (0, 1, 2):
        assert got[i].n_tokens == 0 and got[i].embedding == [0.0] * 64
    assert got[6].n_tokens == 1000 and math.isclose(sum(x * x for x in got[6].embedding), 1)
    assert embed.embedded(rows.limit(0)).count() == 0


REGEXES = [r"[A-Z]{3}-\d{4,}", r"(?:ab|cd)+x?", r"(?i)key=(['\"])\w{5}\1", r"[^a-z\s]{6}", r"a.c", r"\b\d{3}\b", r"(?<!x)q{2,3}?", r"(?>aa|b)z*+", *(p.regex for p in PATTERNS)]


@pytest.mark.parametrize("regex", REGEXES)
def test_values_fit_their_regex(regex):
    values = {samples.value_of(regex, f"seed {i}") for i in range(20)}
    for v in values:
        assert re.search(regex, v, re.ASCII)[0] == v
    assert samples.value_of(regex, "seed 3") == samples.value_of(regex, "seed 3")
    assert len(values) > 1 or regex in (r"(?<!x)q{2,3}?",)


def test_regexes_that_nothing_fits():
    with pytest.raises(ValueError):
        samples.value_of(r"a(?!b)b", "s")


def test_hotwords_that_no_exclusion_takes():
    rules = [Exclusion(words=("admin", " Test "))]
    assert samples.safe_hotwords(Pattern("p", "x", hotwords=("Administrator", "key", "contest")), rules) == ["key"]
    assert samples.safe_hotwords(Pattern("p", "x", hotwords=("admin-cli",)), rules) == ["admin-cli"]


def test_planted_values(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 20)], SCHEMA)
    got = samples.planted(rows, PATTERNS, EXCLUSIONS).collect()
    assert len(got) == len(ODD) * 20 and {r.pattern for r in got} == {p.name for p in PATTERNS}
    for r in got:
        raw = r.text.encode()
        assert raw[r.start : r.start + len(r.value.encode())].decode() == r.value
    again = samples.planted(rows.repartition(5), PATTERNS, EXCLUSIONS)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}


def test_corpus_has_all_contexts_and_kinds(spark):
    words = ["apple", "brick", "cloud", "drum"]
    rows = samples.corpus(spark.range(1000).withColumnRenamed("id", "n"), PATTERNS, EXCLUSIONS, words).collect()
    assert {r.context for r in rows if r.expect_blocked} == set(samples.CONTEXTS) and len(samples.CONTEXTS) == 16
    assert {r.context for r in rows if not r.expect_blocked} == set(samples.NEGATIVES) and len(samples.NEGATIVES) == 11
    assert sum(r.expect_blocked for r in rows) == 800


def test_table_function_agrees_with_the_scan(spark):
    """Rules of every kind, over texts with values planted and texts without."""
    packs = [*PATTERNS, Pattern("needs", r"n=\d+", "n=", "critical", 1, min_matches=2, hotwords=("near",), hotword_window=9, require_hotword=True), Pattern("off", r"\w+", category="gone")]
    rules = [*EXCLUSIONS, Exclusion("NEEDS", "regex", pattern="7$", suppress=True), Exclusion("*", "dictionary", ("n=1 n=1",), window=12)]
    cfg = ScanConfig(disabled=("gone",), large=2500)
    texts = ["near n=1 n=2", "n=1 n=2 far away from near", "near n=17 n=27", "near n=1 n=1 n=1 n=1", "near n=1", *ODD, "4111111111111111 card", "sample 4222222222222222", "(123) 555-0000 call " + "y" * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    rows = rows.unionByName(samples.planted(rows.select((F.col("content_id") + 100).alias("content_id"), "text"), packs[:-1], rules).select("content_id", "text"))
    sqlfunctions.register(spark, packs, rules, cfg)
    got = spark.sql("SELECT * FROM scan_text(TABLE(SELECT content_id, text, 1 AS more FROM {t}))", t=rows)
    same = scan.scan(rows, packs, rules, cfg)
    assert got.columns == same.columns
    # step by step, as columns
    steps = scan.pattern_verdicts(scan.scored(scan._found(rows, packs, cfg, rules), packs, rules, cfg), packs, cfg)
    right = {r.content_id: (False, "", 0) for r in rows.collect()}
    for r in steps.where("blocked").collect():
        right[r.content_id] = min(right[r.content_id], (True, r.pattern, r.score), key=lambda v: (not v[0], -v[2], v[1]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect())) == sorted((i, *v) for i, v in right.items())
    assert 5 < sum(v[0] for v in right.values()) < len(right)
    with pytest.raises(ValueError):
        sqlfunctions.scan_text([Pattern("c", "x", content_types=("code",))])


def test_sql_functions_agree_with_the_columns(spark):
    rows = spark.createDataFrame([(t,) for t in [*ODD, "aab", "a,b\nc,d\ne,f", "K: v\nk=v\nk2: w", "import a\n  import b", '{"a": 1}', "HTTP://Ex.com:80/a?b"]], "t string")
    sqlfunctions.register(spark)
    got = spark.sql("SELECT classify(t) AS c, entropy(t) AS e, host_of(t) AS h FROM {r}", r=rows).collect()
    from riskweave.functions.text import content_type

    right = rows.select(content_type(F.col("t")).alias("c"), entropy(F.col("t")).alias("e")).collect()
    assert [r.c for r in got] == [r.c for r in right]
    assert [r.e or 0.0 for r in got] == [r.e or 0.0 for r in right]
    assert got[-1].h == "ex.com:80"
    assert scan.entropy_of(b"aab") == pytest.approx(got[7].e, abs=1e-11)

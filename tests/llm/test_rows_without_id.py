"""A third of all rows, or more, that no id tells apart."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, language, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, n=600):
    """n rows without an id, half of them equal, n with one id for all, and n with ids; all of one cell."""
    text = lambda i: f"word{i} and nine others that make a short text here"
    out = [(None, text(0 if i % 2 else i), "en", "a", 9) for i in range(n)]
    out += [(7, text(10_000 + i), "en", "a", 9) for i in range(n)] + [(10 + i, text(i), "en", "a", 9) for i in range(n)]
    return spark.createDataFrame(out, SCHEMA)


def groups(df):
    return df.groupBy(F.when(F.col("doc_id").isNull(), "none").when(F.col("doc_id") == 7, "one").otherwise("own").alias("kind"))


def test_samples_are_calibrated_for_all(spark):
    got = {r.kind: (r.n, r.p) for r in groups(mixing.mixed_sample(rows(spark), draw=0.5)).agg(F.count_if("sampled").alias("n"), F.avg("probability").alias("p")).collect()}
    for n, p in got.values():
        assert abs(p - 0.5) < 0.01 and abs(n - 300) < 4.5 * np.sqrt(600 * 0.25)


def test_the_mix_copies_rows_each_for_itself(spark):
    docs = rows(spark)
    got = corpus_pipeline.source_mix(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert all(abs(r["count"] - 300) < 4.5 * np.sqrt(600 * 0.25) for r in groups(got).count().collect())
    assert got.exceptAll(docs).count() == 0


def test_copies_are_those_that_the_weights_ask_for(spark):
    """Of a small cell every row is emitted its whole number of times, and once more with the chance of the rest."""
    small = [(None if i % 3 == 0 else i, f"rare text {i} of six words", "en", "rare", 5) for i in range(30)]
    docs = spark.createDataFrame(small + [(1000 + i, f"common text {i} of six words", "en", "common", 5) for i in range(3000)], SCHEMA)
    mixed = mixing.mixed_sample(docs, draw=corpus_pipeline.DRAW).toPandas()
    wanted = mixed.probability * mixed.weight
    wanted *= corpus_pipeline.DRAW * mixed.n_words.sum() / (wanted * mixed.n_words).sum()
    rare = wanted[mixed.source == "rare"].iloc[0]
    copies = corpus_pipeline.source_mix(spark, docs, "").where("source = 'rare'").groupBy("text").count().toPandas()["count"]
    assert rare > 2 and len(copies) == 30
    assert set(copies) <= {int(rare), int(rare) + 1}
    assert abs(copies.sum() - 30 * rare) < 4.5 * np.sqrt(30 * 0.25) + 1
    # a brute-force version of the weights: two cells, targets by the square roots of their words
    share = np.sqrt(30) / (np.sqrt(30) + np.sqrt(3000))
    assert abs(rare * 30 / (corpus_pipeline.DRAW * 3030) - share) < 0.01


def test_labelled_rows_for_training_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "SAMPLE_EACH", 5)
    monkeypatch.setattr(language.ByteNet, "train", lambda self, x, y: seen.append(len(x)) or self)
    same = [(None, "the same text for all of them", "en", "a", 9)] * 900 + [(7, f"text {i} under one id", "de", "a", 9) for i in range(900)]
    language.trained(spark.createDataFrame(same, SCHEMA).repartition(4), F.lit(True))
    assert 0 < seen[0] <= 2 * 2 * 5 * language.WINDOWS


def test_items_without_an_id_are_hits(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (3, "other words " * 10)], "item_id long, text string")
    row = decontaminate.contamination(docs, items).head()
    assert (row.n_words, row.n_hit, row["items"]) == (40, 40, [])

import corpus_pipeline


def test_mix_reaches_the_share_of_a_small_cell(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(20)), "en", "rare" if i < 4 else "common", 1) for i in range(404)] + [(None, "one two", None, None, 1), (500, None, "en", "rare", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.source_mix(spark, docs, "").toPandas()
    words = got.text.str.split().str.len()
    assert list(got.columns) == corpus_pipeline.COLUMNS and not got.text.isna().any()
    # rare: target 1 / 11 or a little less, 1 % of what is there
    assert 0.06 < words[got.source == "rare"].sum() / words.sum() < 0.12
    assert 0.8 * 4040 < words.sum() < 1.2 * 4040

"""Cases that each operator has to stand: empty tables, columns of other meaning, very long texts; and the network against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import chat, decontaminate, language, lm_score, secret_scan
from riskweave.llm.queries import tokenizer_path


def naive(net, window):
    """Probabilities of one window by the definition: each filter at each place, the largest, rectified, softmax."""
    held = []
    for table in net.tables:
        for f in range(language.FILTERS):
            best = max(sum(float(table[j][window[at + j]][f]) for j in range(len(table))) for at in range(language.LENGTH - len(table) + 1))
            held.append(max(best, 0.0))
    z = [sum(h * float(net.dense[k][c]) for k, h in enumerate(held)) + float(net.bias[c]) for c in range(len(net.languages))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_network_against_plain_loops(spark):
    texts = [(i, [f"the and of that {i} with ", f"der und die nicht {i} ein ", f"les des que dans {i} une "][i % 3] * (1 + i % 12), ["en", "de", "fr"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    net = language.trained(docs, F.lit(True))
    got = {r.doc_id: r for r in language.languages(docs, F.lit(False)).collect()}
    for i, text, _ in texts[:6]:
        rows = language.windows(text.encode())
        each = np.array([naive(net, row) for row in rows])
        size = np.array([np.count_nonzero(row) for row in rows])
        mean = (each * size[:, None]).sum(axis=0) / size.sum()
        assert got[i].lang_pred == net.languages[int(mean.argmax())] and got[i].score == pytest.approx(mean.max(), abs=1e-4)
        assert np.allclose(net.probabilities(rows), each, atol=1e-4)


def test_training_lowers_the_loss():
    """Of 960 windows with and without a run of bytes, over 90 steps of training."""
    rng = np.random.default_rng(5)
    x = rng.integers(97, 101, (960, language.LENGTH)).astype(np.uint8)
    y = np.arange(960) % 2
    x[y == 1, 10:14] = np.frombuffer(b"zzzz", np.uint8)
    net = language.ByteNet(["a", "b"])
    loss = lambda n: -np.log(n.probabilities(x)[np.arange(960), y]).mean()
    before = loss(net)
    assert loss(net.train(x, y)) < 0.2 * before


@pytest.fixture
def strange(odd):
    """All columns that operators make, under the caller's names."""
    names = ["mark", "n", "digest", "bands", "value", "before", "key", "row_key", "word", "c", "held_out", "score", "starts", "items", "features", "label", "probability"]
    return odd.drop("n", "key").withColumns({c: F.lit("x") for c in names})


def test_columns_of_other_meaning(spark, strange, odd):
    assert lm_score.lm_scores(strange, tokenizer_path("piece_bpe_32k.model")).count() == odd.count()
    assert language.languages(strange, F.lit(False)).count() == odd.count()
    assert secret_scan.secrets(strange).count() == odd.count()
    items = spark.createDataFrame([(1, "alpha beta", "x", 2)], "item_id long, text string, item string, hash int")
    assert decontaminate.contamination(strange, items).count() == odd.count()
    log = spark.createDataFrame([(1, 0, "user", "hi", 7, "x", "y")], "conv_id long, turn long, role string, text string, seq long, kind string, message string")
    row = chat.read_back(chat.formatted(chat.messages(chat.as_events(log)))).head()
    assert [(t.role, t.text) for t in row.turns] == [("user", "hi")]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert lm_score.lm_scores(none, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert language.languages(none, F.lit(False)).count() == 0
    assert secret_scan.secrets(none).count() == 0
    log = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.messages(chat.as_events(log)))).count() == 0


def test_very_long_texts(spark):
    text = "und die nicht ein der password=hunter2x " * 20_000
    docs = spark.createDataFrame([(1, text, "de"), (2, "the and of", "en")] + [(3 + i, "the and of that with it ", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.languages(docs, F.lit(False)).collect()}[1] == "de"
    found = {r.doc_id: r.n_candidates for r in secret_scan.secrets(docs).collect()}
    assert found[1] == 20_000 and found[2] == 0
    assert {r.doc_id: r.n_tokens for r in lm_score.lm_scores(docs, tokenizer_path("piece_bpe_32k.model")).collect()}[1] == 120_001


def test_planted_secrets_of_the_test_tables(spark):
    """Values after `token = ` in documents: all are found, and nothing else in those documents is."""
    import os
    import re

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text like '%token = \"%'")
    planted = {r.doc_id: len(re.findall(r'token = "[0-9a-f]{40}"', r.text)) for r in docs.collect()}
    got = {r.doc_id: r.n_secrets for r in secret_scan.secrets(docs).collect()}
    assert sum(planted.values()) >= 12 and got == planted

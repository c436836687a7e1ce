import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riskweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(str(item), rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes, query_bytes", [(lexical.SHARD_BYTES, lexical.QUERY_BYTES), (500, 60)])
def test_search(spark, odd, shard_bytes, query_bytes):
    texts = [(1, "alpha1 BETA2 beta2, short"), (2, "text"), (3, None), (4, ""), (5, "!?"), (5, "é ü-漢字 nowhere"), (None, "alpha1 gamma3 delta4"), (7, "alpha1 " * 50), (7, "alpha1 " * 50)]
    items = spark.createDataFrame([(*x, 1) for x in texts], ITEMS)
    docs = odd.repartition(3)
    got = lexical.search(lexical.build_index(docs, shard_bytes), items, 5, query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got.collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in odd.collect()], texts, 5)


def test_ties_across_shards(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 2 else f"other{i}") for i in range(200)], "doc_id long, text string").repartition(8)
    got = lexical.search(lexical.build_index(docs, 40), spark.createDataFrame([(1, "words", 0)], ITEMS), 20).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(k + 1, 2 * k + 1) for k in range(20)]


def test_row_groups_do_not_grow_with_a_tasks_shards(spark):
    docs = spark.createDataFrame([(i, f"same words here other{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a shard has one batch at least
    try:
        shards = lexical.build_index(docs, 40).shards
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards.count() == 100
    for file in shards.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 4


def test_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "alpha1", 0)], ITEMS)
    assert lexical.search(lexical.build_index(odd.limit(0)), items).count() == 0
    assert lexical.search(lexical.build_index(odd), items.limit(0)).count() == 0


def test_best_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores, ids, has = rng.integers(0, 6, 40), rng.permutation(40), rng.random(40) < 0.8
        right = sorted((i for i in range(40) if scores[i] > 0), key=lambda i: (-scores[i], not has[i], ids[i]))[:7]
        assert lexical.best(scores, ids, has, 7).tolist() == right


def test_number_of_terms_over_all_texts_at_once():
    texts = ["ab cd", "", None, "x", "-", "é漢 1a", "a", "b"]
    assert lexical.n_terms(pa.array(texts, pa.string()).slice(1)).tolist() == [len(terms(t)) for t in texts[1:]]
    assert lexical.n_terms(pa.array([], pa.string())).tolist() == []

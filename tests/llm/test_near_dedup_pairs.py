"""How many pairs are judged, and which links are found."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import near_dedup
from riskweave.llm.common import WordHashes


def passages(n, seed=1):
    """Documents of 4 of 20 shared passages of 40 words, and 25 words of their own."""
    rng = random.Random(seed)
    shared = [[f"p{k}w{i}" for i in range(40)] for k in range(20)]
    out = []
    for d in range(n):
        parts = [*rng.sample(shared, 4), [f"d{d}w{i}" for i in range(25)]]
        rng.shuffle(parts)
        out.append((d, " ".join(w for p in parts for w in p)))
    return out


def judged(spark, texts):
    """Pairs that share a bucket after the second deal, where all texts are live."""
    rows = spark.createDataFrame(texts, "rep long, text string")
    held = near_dedup._refined(rows, rows).groupBy("key").count()
    return held.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0] or 0


def test_few_pairs_are_judged_where_all_texts_share_passages(spark):
    """Of 2,400 texts of which nearly two thirds of all pairs share a passage, and of 600 such."""
    few, many = (judged(spark, passages(n)) for n in (600, 2400))
    assert few <= 600 * 5 and many <= 2400 * 20


def components(texts):
    sets = {i: near_dedup.shingle_set(t.encode().lower().split(), WordHashes()).tolist() for i, t in texts}
    holders, both = defaultdict(list), defaultdict(int)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        mine = defaultdict(int)
        for x in s:
            for j in holders[x]:
                mine[j] += 1
            holders[x].append(i)
        for j, n in mine.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                both[i, j] = n
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_shared_passages_against_brute_force(spark):
    texts = passages(500, 3)
    texts += [(1000 + i, t.replace(f"d{d}w3", "changed")) for i, (d, t) in enumerate(texts[:50])]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(texts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_all_links_of_the_test_tables(spark):
    """Every component of the 1,000 documents as by comparing all pairs: recall and precision 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text and r.text.split()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: got[i] for i, _ in texts} == components(texts)

"""Each operator's query against the same in SQL on the smallest tables."""

import os

import duckdb
import pytest

from riskweave.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(df):
    show = lambda v: "null" if v is None or str(v) in ("<NA>", "nan") else f"{v:.5f}" if isinstance(v, float) else str(v)
    df = df.convert_dtypes()
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, right = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(right.columns)
    assert rows(got) == rows(right)

"""Each query against the same in SQL on the smallest tables."""

import numbers
import os

import duckdb
import pytest

from riskweave.oracle import ORACLE_SQL
from riskweave.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def rows(df):
    show = lambda v: "null" if v is None or str(v) in ("<NA>", "nan") else f"{v:.5f}" if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())



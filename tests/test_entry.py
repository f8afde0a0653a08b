"""The entry module, and every base query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shoalspark import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_as_sql(spark, db, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), db.sql(q.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    for d in (got, want):
        for c in cols:
            if d[c].dtype.kind in "iuf":
                d[c] = d[c].astype(float)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            assert ((got[c] - want[c]).abs() < 1e-7).eq(True).where(got[c].notna() | want[c].notna(), True).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL) - {"map_invert"}))
def test_python_queries_give_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0

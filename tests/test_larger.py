"""Queries on tables that the smallest ones do not stand for: grown, with gaps, with rows in one place; against their SQL."""

import math

import duckdb
import pytest

from shoalspark import queries as q
from shoalspark import queries_more as more  # noqa: F401  its queries join base's

SF = "/root/testdata/sf0.001"


def as_sql(spark, name, folder, **tables):
    """Writes ``tables`` (SQL) into ``folder`` and compares the query's rows with its SQL's, as they are."""
    db = duckdb.connect()
    for t, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = db.execute(q.SQL[name])
    cols = [c[0] for c in cur.description]
    plain = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)
    want = sorted(map(plain, cur.fetchall()), key=repr)
    got = sorted((plain(r) for r in q.QUERIES[name](spark, str(folder)).select(*cols).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == tuple(pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for v in b)


def test_scene_whose_last_line_is_cut_and_whose_lines_have_gaps(spark, tmp_path):
    as_sql(spark, "pix_scene", tmp_path, embeddings=f"SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 61 AND vec_id NOT BETWEEN 20 AND 27")


def test_projection_far_from_the_first_rows(spark, tmp_path):
    as_sql(spark, "projection_round_trip", tmp_path, embeddings=f"SELECT vec_id + k * 1000003 AS vec_id, embedding, label FROM '{SF}/embeddings.parquet', range(12) t(k)")


def test_sun_at_noon(spark, tmp_path):
    as_sql(spark, "sun_by_hour_angle", tmp_path, events="SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE abs(datediff('second', date_trunc('day', ts), ts) - 44280) < 100")

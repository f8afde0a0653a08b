"""Draws of known posteriors and their diagnostics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import sampling


def gaussian(b):
    """Correlated normals: mean (m, -m), deviations (1, 3), correlation 0.6."""
    mean = np.column_stack([b.column("m").to_numpy(), -b.column("m").to_numpy()])
    p = np.linalg.inv(np.array([[1.0, 1.8], [1.8, 9.0]]))
    return lambda x: (0.5 * np.einsum("ni,ij,nj->n", x - mean, p, x - mean), (x - mean) @ p), np.zeros((b.num_rows, 2))


def test_draws_of_a_known_posterior(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(6)], "id int, m double").repartition(3)
    draws = sampling.draw_table(rows, ["id"], gaussian, ["a", "b"], draws=400, warmup=300)
    assert draws.count() == 6 * 4 * 400
    for r in sampling.summary(draws, ["id"], ["a", "b"], 400).collect():
        sd = 1 if r["parameter"] == "a" else 3
        mean = r["id"] if r["parameter"] == "a" else -r["id"]
        assert 100 < r["ess"] <= 1600 and r["rhat"] < 1.05
        assert abs(r["mean"] - mean) < 5 * sd / r["ess"] ** 0.5 and r["sd"] == pytest.approx(sd, rel=0.25)
    again = sampling.draw_table(rows.repartition(1), ["id"], gaussian, ["a", "b"], draws=400, warmup=300, batch=5)
    key = lambda df: df.where("draw = 399 and chain = 2").select("id", F.round("a", 9).alias("a")).orderBy("id").collect()
    assert key(draws) == key(again)  # whatever the partitions


def test_diagnostics_as_by_hand(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3, 100)) + np.array([[0.0], [0.0], [2.0]])  # one chain is elsewhere
    d = spark.createDataFrame([(1, c, k, float(v[c, k])) for c in range(3) for k in range(100)], "id int, chain int, draw int, a double")
    r = sampling.summary(d, ["id"], ["a"], 100).first()
    halves = v.reshape(6, 50)
    w, b = halves.var(axis=1, ddof=1).mean(), halves.mean(axis=1).var(ddof=1)
    assert r["mean"] == pytest.approx(v.mean()) and r["sd"] == pytest.approx(v.std(ddof=1)) and r["rhat"] == pytest.approx(((49 / 50 * w + b) / w) ** 0.5) and r["rhat"] > 1.2
    runs = v.reshape(30, 10).mean(axis=1).var(ddof=1)
    assert r["ess"] == pytest.approx(300 * v.var(ddof=1) / (10 * runs))


def test_summary_of_draws_kept_in_their_task_is_that_of_the_table(spark):
    rows = spark.createDataFrame([(i, 2.0 * i) for i in range(12)], "id int, m double")
    for draws in (400, 111):
        table = sampling.summary(sampling.draw_table(rows, ["id"], gaussian, ["a", "b"], draws=draws, warmup=100), ["id"], ["a", "b"], draws)
        want = {(r["id"], r["parameter"]): r for r in table.collect()}
        got = sampling.drawn_summary(rows, ["id"], gaussian, ["a", "b"], draws=draws, warmup=100, batch=7).collect()
        assert len(got) == len(want) == 24
        for r in got:
            assert all(r[c] == pytest.approx(want[r["id"], r["parameter"]][c], rel=1e-6) for c in ("mean", "sd", "rhat", "ess"))


def test_noise_is_normal_and_apart_by_seed_and_step():
    seeds = np.arange(-500, 500, dtype=np.int64).view(np.uint64)
    u = np.stack([sampling.uniforms(seeds, k, 5) for k in range(100)])
    assert len(np.unique(u)) == u.size and abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.001
    z = np.stack([sampling.normals(x[:, :4]) for x in u])
    assert abs(z.mean()) < 0.01 and abs(z.var() - 1) < 0.01 and abs((z**4).mean() - 3) < 0.1 and abs(np.corrcoef(z.reshape(-1, 4).T) - np.eye(4)).max() < 0.02

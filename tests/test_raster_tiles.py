"""Tiled raster operators against plain loops, whatever the tile."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import raster


def table(spark, grid):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "row int, col int, v double")


def brute_fill(grid, distance):
    known = [(r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None and not math.isnan(v)]
    out = {}
    for r, row in enumerate(grid):
        for c, v in enumerate(row):
            if v is not None and not math.isnan(v):
                out[r, c] = v
                continue
            best = {}
            for y, x, z in known:
                d = math.hypot(y - r, x - c)
                k = (x > c, y > r)
                if d <= distance and (d, abs(x - c)) < best.get(k, (math.inf, 0, 0))[:2]:
                    best[k] = d, abs(x - c), z
            out[r, c] = sum(z / d for d, _, z in best.values()) / sum(1 / d for d, _, _ in best.values()) if best else None
    return out


@pytest.mark.parametrize("tile", [5, 64])
@pytest.mark.parametrize("distance", [3, 9])
def test_gaps_take_the_nearest_of_each_quadrant(spark, tile, distance):
    rng = np.random.default_rng(distance)
    grid = [[float(rng.integers(1, 99)) if rng.random() < 0.06 else rng.choice([None, math.nan]) for _ in range(23)] for _ in range(17)]
    got = {(r["row"], r["col"]): r["filled"] for r in raster.fill_quadrants(table(spark, grid), "v", distance, tile).collect()}
    want = brute_fill(grid, distance)
    assert got.keys() == want.keys() and any(v is None for v in want.values()) == (None in got.values())
    assert all(got[k] == (v if v is None else pytest.approx(v)) for k, v in want.items())


def test_gaps_of_an_empty_or_missing_grid(spark):
    assert raster.fill_quadrants(table(spark, []), "v").count() == 0
    assert {r["filled"] for r in raster.fill_quadrants(table(spark, [[None] * 3] * 3), "v").collect()} == {None}


def test_cubic_resampling_is_exact_for_cubics_along_an_axis(spark):
    f = lambda y, x: 0.02 * x * x - x + 0.5 * y  # noqa: E731  reproduced by cubic convolution
    src = table(spark, [[f(r, c) for c in range(30)] for r in range(20)])
    points = [(k, 0.5 + 1.5 + 0.37 * k, 0.5 + 1.2 + 0.21 * k) for k in range(70)] + [(90, 0.7, 5.0), (91, 99.0, 5.0), (92, None, 5.0), (93, float("nan"), 5.0)]
    target = spark.createDataFrame(points, "id int, x double, y double").withColumn("v", F.lit("clash"))
    for tile in (7, 256):
        got = {r["id"]: r["v"] for r in raster._cubic(target, src, "v", (1, 0, 0, 0, 1, 0), tile).collect()}
        assert len(got) == 74 and all(got[k] is None for k in (90, 91, 92, 93))
        for k, x, y in points[:70]:
            assert got[k] == pytest.approx(f(y - 0.5, x - 0.5)) if x < 27.5 and y < 17.5 else True
    holed = src.where("not (row = 6 and col = 10)")
    got = {r["id"]: r["v"] for r in raster.resample(target, holed, "v", (1, 0, 0, 0, 1, 0), "cubic").collect()}
    assert got[23] is None and got[0] is not None


def test_blur_does_not_depend_on_the_tile(spark):
    rng = np.random.default_rng(4)
    grid = [[None if rng.random() < 0.2 else float(rng.random()) for _ in range(21)] for _ in range(13)]
    got = [{(r["row"], r["col"]): r["smooth"] for r in raster.gaussian(table(spark, grid), "v", 1.5, tile=t).collect()} for t in (4, 99)]
    k = dict(raster.kernel(1.5))
    for (r, c), v in got[0].items():
        near = [(k[y - r] * k[x - c], grid[y][x]) for y in range(13) for x in range(21) if y - r in k and x - c in k and grid[y][x] is not None]
        assert v == pytest.approx(sum(w * z for w, z in near) / (sum(w for w, _ in near) + 1e-12)) and got[1][r, c] == pytest.approx(v)


def test_covariance_of_bands_with_gaps(spark):
    from shoalspark.operators import spectral

    rows = [([1e6 + 1.0, 2.0, None],), ([1e6 + 2.0, 1.0, 5.0],), ([1e6 + 4.0, float("nan"), 6.0],), ([1e6, 7.0, 2.0],), (None,)]
    got = {(r["i"], r["j"]): r["cov"] for r in spectral.covariance(spark.createDataFrame(rows, "s array<double>").repartition(3), "s", 3).collect()}
    cov = lambda x, y: np.cov(x, y)[0, 1]
    assert got[0, 1] == pytest.approx(cov([1, 2, 0], [2, 1, 7])) and got[0, 2] == pytest.approx(cov([2, 4, 0], [5, 6, 2])) and got[1, 2] == pytest.approx(cov([1, 7], [5, 2]))
    assert got[0, 0] == pytest.approx(np.var([1, 2, 4, 0], ddof=1))
    one = {r["cov"] for r in spectral.covariance(spark.createDataFrame(rows[:1], "s array<double>"), "s", 3).collect()}
    assert one == {0.0}


def test_cubic_resampling_of_a_crowded_tile_is_dealt_in_parts(spark):
    src = table(spark, [[float((3 * r + 5 * c) % 11) for c in range(12)] for r in range(12)])
    target = spark.range(900).selectExpr("id", "1.6 + (id % 30) * 0.3 as x", "2.2 + (id div 30) * 0.25 as y")
    whole, parts = ({r["id"]: r["v"] for r in raster._cubic(target, src, "v", (1, 0, 0, 0, 1, 0), 5, most).collect()} for most in (10**6, 20))
    assert whole == parts and len(parts) == 900 and sum(v is not None for v in parts.values()) > 700

"""Outlines against the cells they go round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import outline


def table(spark, grid):
    return spark.createDataFrame([(r, c, int(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "row int, col int, seg_id int")


def filled(rows, shape):
    """Cells inside a label's rings, by even-odd count of the upright sides left of each."""
    out = np.zeros(shape, int)
    for r in rows:
        xs, ys = r["x"], r["y"]
        for x0, y0, x1, y1 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1]):
            assert (x0 == x1) != (y0 == y1)
            if x0 == x1:
                out[min(y0, y1) : max(y0, y1), x0:] ^= 1
    return out.astype(bool)


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_rings_go_round_their_cells(spark, tile):
    rng = np.random.default_rng(tile)
    noise = rng.integers(0, 4, (23, 19))  # corners that touch, holes, single cells
    frame = np.zeros((23, 19), int)
    frame[2:20, 1:18], frame[5:15, 4:12], frame[7:12, 6:9], frame[8:9, 7:8] = 1, 0, 1, 2
    for grid in (noise, frame, np.ones((6, 30), int)):
        rows = outline.rings(table(spark, grid), tile).collect()
        for label in set(grid.ravel()) - {0}:
            own = [r for r in rows if r["seg_id"] == label]
            assert (filled(own, grid.shape) == (grid == label)).all()
            assert sum(r["area"] for r in own) == (grid == label).sum()
            for r in own:
                d = np.sign(np.diff(np.column_stack([r["x"] + r["x"][:2], r["y"] + r["y"][:2]]), axis=0))
                assert (d[1:] != d[:-1]).any(axis=1).all()  # no corner on a straight line
                assert r["hole"] == (r["area"] < 0) == (r["ring"] > 0)
    rows = outline.rings(table(spark, frame), tile).collect()
    ones = sorted((r["shell"], r["ring"], r["area"]) for r in rows if r["seg_id"] == 1)
    assert ones == [(0, 0, 18 * 17.0), (0, 1, -80.0), (1, 0, 15.0), (1, 1, -1.0)]


def test_same_rings_whatever_the_tiles(spark):
    grid = np.random.default_rng(0).integers(0, 3, (20, 20))
    got = [sorted(map(tuple, outline.rings(table(spark, grid), t).select("seg_id", "shell", "ring", "area", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y")).collect())) for t in (4, 9, 32)]
    assert got[0] == got[1] == got[2]


def test_text_places_and_footprint(spark):
    grid = np.array([[5, 5, 5], [5, 0, 5], [5, 5, 5], [0, 0, 0], [5, 0, 0]])
    out = outline.rings(table(spark, grid), 2)
    assert outline.wkt(out).collect()[0]["wkt"] == "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((0 4, 1 4, 1 5, 0 5, 0 4)))"
    one = outline.placed(out.where("area = 1"), (2, 0, 100, 0, -2, 50)).first()
    assert one["x"] == [100, 102, 102, 100] and one["y"] == [42, 42, 40, 40]
    assert outline.footprint(table(spark, grid).withColumn("valid", F.col("seg_id") > 0)).agg(F.sum("area")).first()[0] == 9
    assert outline.rings(table(spark, grid * 0), 2).count() == 0

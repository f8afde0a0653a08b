"""SLIC: connected segments that do not depend on the tiles."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import imageseg


def scene(spark, h, w, seed=0):
    rng = np.random.default_rng(seed)
    r, c = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    f0 = np.sin(r / 9) + np.cos(c / 7) + 0.1 * rng.standard_normal((h, w))
    f1 = (r > c).astype(float) + 0.1 * rng.standard_normal((h, w))
    f1[(r - 20) ** 2 + (c - 15) ** 2 < 40] = np.nan
    return spark.createDataFrame(pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "f0": f0.ravel(), "f1": f1.ravel()}))


def labels(df, h, w):
    out = np.zeros((h, w), np.int64)
    for r in df.collect():
        out[r["row"], r["col"]] = r["seg_id"]
    return out


def test_same_segments_whatever_the_tile_and_all_connected(spark):
    h, w = 70, 90
    px = scene(spark, h, w)
    got = [labels(imageseg.segment(px, ["f0", "f1"], "slic", tile=t, area=25, compactness=0.3, rounds=2), h, w) for t in (16, 37, 128)]
    assert (got[0] == got[1]).all() and (got[0] == got[2]).all()
    lab = got[0]
    masked = px.where("isnan(f1)").count()
    assert (lab == 0).sum() == masked > 0
    ids = np.unique(lab[lab > 0])
    assert 0.4 * (h * w - masked) / 25 < len(ids) < 2.5 * (h * w - masked) / 25
    valid = lab.ravel() > 0
    pairs = [(a[(lab.ravel()[a] == lab.ravel()[b]) & valid[a]], b[(lab.ravel()[a] == lab.ravel()[b]) & valid[a]]) for a, b in imageseg._pairs(h, w)]
    root = imageseg.components(pairs, h * w)
    assert len(np.unique(root[valid])) == len(ids)  # a segment is one connected part
    first = {i: np.flatnonzero(lab.ravel() == i)[0] for i in ids}
    assert all(np.bincount(np.searchsorted(ids, lab[lab > 0])) >= 1) and len(set(first.values())) == len(ids)


def test_segments_follow_an_edge(spark):
    px = spark.range(40 * 40).select(F.expr("cast(id div 40 as int)").alias("row"), (F.col("id") % 40).cast("int").alias("col")).withColumn("f", F.when(F.col("col") < 17, 0.0).otherwise(9.0))
    lab = labels(imageseg.segment(px, ["f"], "slic", area=36, compactness=0.1), 40, 40)
    assert not set(lab[:, :17].ravel()) & set(lab[:, 17:].ravel())


def test_components_and_small_parts():
    grid = np.array([[0, 0, 1, 1], [0, 2, 1, 1], [3, 3, 3, 1]])
    ok = np.ones_like(grid, bool)
    ok[2, 0] = False
    got = imageseg.connected_labels(grid, ok, 2)
    assert got[1, 1] == got[0, 0] and got[2, 0] == -1 and len(set(got[ok])) == 3
    assert imageseg.components([(np.array([], int), np.array([], int))], 3).tolist() == [0, 1, 2]


def test_a_tile_in_seconds():
    rng = np.random.default_rng(1)
    x, ok = rng.standard_normal((256, 256, 3)), np.ones((256, 256), bool)
    start = time.perf_counter()
    lab = imageseg.connected_labels(imageseg.slic_clusters(x, ok, 0, 0, 7.0, 0.5, 10), ok, 12)
    assert len(np.unique(lab)) > 500 and time.perf_counter() - start < 9  # under 3 s on an idle core


def test_nothing_to_segment(spark):
    px = spark.createDataFrame([(0, 0, None), (0, 1, float("nan"))], "row int, col int, f double")
    assert {r["seg_id"] for r in imageseg.segment(px, ["f"], "slic").collect()} == {0}
    assert imageseg.segment(px.limit(0), ["f"], "slic").count() == 0


def test_features_of_shape_and_magnitude_feed_the_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(r, c, (rng.uniform(1, 2) * np.array([1, 2, 3.0] if c < 8 else [3, 2, 1.0]) + 0.01 * rng.standard_normal(3)).tolist()) for r in range(16) for c in range(16)] + [(16, 0, [0.0, 0.0, 0.0])]
    px = spark.createDataFrame(rows, "row int, col int, s array<double>")
    f = imageseg.magnitude_features(px, "s", 3, ["row", "col"], 2)
    got = np.array([x["features"] for x in f.where("features is not null").collect()])
    assert len(got) == 256 and np.allclose(got.mean(axis=0), 0, atol=1e-9) and np.allclose(got.std(axis=0), 1, atol=0.01)
    x = np.array([r[2] for r in rows[:-1]])
    shape = x / x.sum(axis=1, keepdims=True)
    values = np.linalg.eigvalsh(np.cov(shape.T))[::-1][:2]
    assert np.allclose(imageseg.moment_pca(imageseg.normalised_features(px.where("row < 16"), "s", ["row"]), "shape", 3, 2)[2], values)
    flat = f.select("row", "col", *[F.get("features", F.lit(j)).alias(f"f{j}") for j in (0,)])
    lab = labels(imageseg.segment(flat, ["f0"], "slic", area=16, compactness=0.1), 17, 16)
    assert not set(lab[:16, :8].ravel()) & set(lab[:16, 8:].ravel()) and lab[16, 0] == 0

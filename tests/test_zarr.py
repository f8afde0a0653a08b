"""Stored scenes: windows that read their chunks only, and regions written in place."""

import os

import pytest
from pyspark.sql import functions as F

from shoalspark.sources import zarr


@pytest.fixture
def scene(spark, tmp_path):
    """20 bands of 13 by 17 cells in chunks of 5 bands, 4 by 4 cells; one cell is missing."""
    path = str(tmp_path / "scene")
    px = spark.range(13 * 17).select(F.expr("cast(id div 17 as int)").alias("row"), (F.col("id") % 17).cast("int").alias("col"))
    px = px.where("not (row = 2 and col = 3)").withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda b: b * 1000.0 + F.col("row") * 20 + F.col("col")))
    zarr.write_scene(px, "s", [400.0 + 10 * k for k in range(20)], (2, 0, 10, 0, -2, 90), (13, 17), path, "rho", tile=4, band_chunk=5)
    return path, px


def values(df):
    return {(r["i0"], r["i1"], r["i2"]): r["value"] for r in df.collect()}


def test_ranges_of_indices_choose_the_chunks(spark, scene):
    path, _ = scene
    source = zarr.array_source(spark, path, "rho")
    assert source.rdd.getNumPartitions() == 4 * 4 * 5
    one = zarr.array_source(spark, path, "rho", {0: (7, 7), 1: (4, 7), 2: (9, 10)})
    assert one.rdd.getNumPartitions() == 1
    assert values(one) == {(7, r, c): 7000.0 + 20 * r + c for r in range(4, 8) for c in (9, 10)} == values(source.where("i0 = 7 and i1 between 4 and 7 and i2 in (9, 10)"))
    assert zarr.array_source(spark, path, "rho", {0: (15, 99), 1: (-5, 3)}).rdd.getNumPartitions() == 5
    assert zarr.array_source(spark, path, "rho", {0: (99, 99)}).count() == 0 and source.where("value > 19000").count() == 13 * 17 - 2


def test_a_window_reads_only_its_chunks(spark, scene):
    path, _ = scene
    for name in os.listdir(f"{path}/rho"):  # the window's chunk alone is left whole
        if name[0] != "." and name != "1.1.2":
            with open(f"{path}/rho/{name}", "wb") as f:
                f.write(b"broken")
    got = zarr.read_window(spark, path, "rho", {0: (7, 7), 1: (4, 7), 2: (8, 9)})
    assert values(got) == {(7, r, c): 7000.0 + 20 * r + c for r in range(4, 8) for c in (8, 9)}
    assert zarr.read_window(spark, path, "rho", {0: (50, 60)}).count() == 0
    with pytest.raises(FileNotFoundError):
        zarr.read_window(spark, path, "none")


def test_a_region_changes_its_cells_only(spark, scene):
    path, px = scene
    part = px.where("row between 3 and 9 and col between 2 and 13").select("row", "col", F.transform("s", lambda v: -v).alias("s"))
    zarr.write_region(part.unionByName(spark.createDataFrame([(0, 0, None)], "row int, col int, s array<double>")), "s", path, "rho")
    got = values(zarr.read_window(spark, path, "rho"))
    for (b, r, c), v in got.items():
        x = b * 1000.0 + r * 20 + c
        assert v == (None if (r, c) in ((2, 3), (0, 0)) else -x if 3 <= r <= 9 and 2 <= c <= 13 else x)
    assert not [n for n in os.listdir(f"{path}/rho") if "new" in n]


def test_new_arrays_are_consolidated(spark, scene):
    path, _ = scene
    zarr.add_array(path, "label", (13, 17), (4, 4), ["y", "x"], "<i4", {"units": "1"})
    assert zarr.metadata(spark, path, "label")["shape"] == [13, 17] and zarr.read_window(spark, path, "label").count() == 0
    zarr.write_region(spark.createDataFrame([(12, 16, 7), (0, 1, 5)], "row int, col int, v int"), "v", path, "label")
    got = {(r["i0"], r["i1"]): r["value"] for r in zarr.read_window(spark, path, "label").where("value is not null").collect()}
    assert got == {(12, 16): 7.0, (0, 1): 5.0} and zarr.attributes(path, "label")["units"] == "1"


def test_a_write_that_fails_leaves_the_scene_as_it_was(spark, scene):
    path, px = scene
    before, files = values(zarr.read_window(spark, path, "rho")), sorted(os.listdir(f"{path}/rho"))

    @F.udf("array<double>")
    def dies(s, row):
        if row == 12:
            os._exit(1)  # the worker is gone in the middle of a task
        return [0.0] * 20

    with pytest.raises(Exception):
        zarr.write_region(px.select("row", "col", dies("s", "row").alias("s")), "s", path, "rho")
    assert sorted(os.listdir(f"{path}/rho")) == files and values(zarr.read_window(spark, path, "rho")) == before
    zarr.write_region(px.select("row", "col", F.transform("s", lambda _: F.lit(0.0)).alias("s")), "s", path, "rho")
    assert {v for v in values(zarr.read_window(spark, path, "rho")).values()} == {0.0, None}

"""Scenes as tables: raw cubes to pixels, Parquet in and out, in-situ files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo

REQUIRED = ("uuid", "date_time", "lat", "lon", "wavelength", "rho")


def read_pixels(spark: SparkSession, path: str, tiles: Column | None = None) -> DataFrame:
    """Pixels of stored scenes; a predicate on image_id, tile_y, tile_x prunes partitions."""
    df = spark.read.parquet(f"{path}/pixels")
    return df.where(tiles) if tiles is not None else df


def write_scene(pixels: DataFrame, scene: DataFrame, path: str) -> None:
    """Pixels partitioned by scene and tile, and one metadata row a scene with its geotransform string."""
    pixels.repartition("image_id", "tile_y", "tile_x").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("image_id", "tile_y", "tile_x").parquet(f"{path}/pixels")
    a = lambda i: F.get("affine", F.lit(i)).cast("string")
    scene.withColumn("geo_transform", F.concat_ws(" ", a(2), a(0), a(1), a(5), a(3), a(4))).write.mode("overwrite").parquet(f"{path}/scene")


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/scene")


def decode_metadata(x: Sequence[float], y: Sequence[float]) -> tuple[float, ...]:
    """Affine of pixel centres: the corner is half a pixel out."""
    dx, dy = (x[-1] - x[0]) / (len(x) - 1), (y[-1] - y[0]) / (len(y) - 1)
    return (dx, 0.0, x[0] - dx / 2, 0.0, dy, y[0] - dy / 2)


def decode_radiance(raw: Column, scale: float, nodata: float) -> Column:
    """Packed counts to radiance; zero and the no-data count are missing."""
    return F.transform(raw, lambda v: F.when((v != 0) & (v != nodata), v * scale))


def place(pixels: DataFrame, affine: geo.Affine, tile: int = 256, at: str = "center") -> DataFrame:
    x, y = geo.grid_xy(F.col("col"), F.col("row"), affine, at)
    ty, tx = geo.tile(F.col("row"), F.col("col"), tile)
    return pixels.withColumns({"x": x, "y": y, "tile_y": ty, "tile_x": tx})


def read_insitu(spark: SparkSession, path: str) -> DataFrame:
    """CSV with any header case; the required columns are checked; times are UTC."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    number = ("lat", "lon", "wavelength", "rho")
    return df.withColumns({c: F.col(c).cast("double") for c in number}).withColumn("date_time", F.to_timestamp("date_time"))


def read_library(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Optics CSV: ``wl`` is renamed, columns are checked, all but ``class`` are numbers."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[re.sub(r"^wl$", "wavelength", c.strip().lower()) for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c != "class"})


def sql_safe(name: str) -> str:
    """Brackets, dots, dashes, blanks and parentheses become underscores."""
    return re.sub(r"_+", "_", re.sub(r"[\[\].\- ()]", "_", name)).strip("_")


def write_table(df: DataFrame, path: str) -> None:
    df.toDF(*map(sql_safe, df.columns)).write.mode("overwrite").parquet(path)


def fill_scalars(existing: DataFrame, new: DataFrame, cols: Sequence[str], key: str = "image_id") -> DataFrame:
    """Add scene scalars; those that are there stay."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = existing.join(n, key, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") if c in existing.columns else F.col(f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])


class RawCube(DataSource):
    """``spark.read.format("raw_cube")``: band-sequential float32 cubes, one partition per block of lines.

    Options: path, samples, lines, bands, block (lines a partition). Rows: row, col, radiance.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_cube"

    def schema(self) -> str:
        return "row int, col int, radiance array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _RawCubeReader(self.options)


class _RawCubeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.samples, self.lines, self.bands = (int(options[k]) for k in ("samples", "lines", "bands"))
        self.block = int(options.get("block", 256))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.block, self.lines))) for a in range(0, self.lines, self.block)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A record batch a line."""
        a, b = partition.value
        cube = np.memmap(self.path, np.float32, "r", shape=(self.bands, self.lines, self.samples))
        for r in range(a, b):
            spectra = np.ascontiguousarray(cube[:, r, :].T).ravel()
            ends = pa.array(np.arange(self.samples + 1) * self.bands, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(self.samples, r), pa.int32()), pa.array(np.arange(self.samples), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(spectra))], names=["row", "col", "radiance"])


def write_raw_cube(pixels: DataFrame, spectrum: str, path: str, samples: int, lines: int, bands: int, block: int = 256) -> None:
    """Pixels (row, col, spectrum) as a band-sequential float32 cube in a folder that all executors share; cells that are not there are NaN.

    The file gets its length first; blocks of lines are then written in place, each by one task and the same if twice.
    """
    with open(path, "wb") as f:
        f.truncate(4 * samples * lines * bands)

    def store(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() * block
        n = min(block, lines - first)
        part = np.full((bands, n, samples), np.nan, np.float32)
        rows, cols = table.column("row").to_numpy(), table.column("col").to_numpy()
        there = [s is not None for s in table.column("s").to_pylist()]
        values = np.array([[np.nan if v is None else v for v in s] for s in table.column("s").to_pylist() if s is not None], np.float32).reshape(-1, bands)
        part[:, rows[there] - first, cols[there]] = values.T
        with open(path, "r+b") as f:
            for k in range(bands):
                f.seek(4 * samples * (k * lines + first))
                f.write(part[k].tobytes())
        return pa.table({"n": pa.array([1], pa.int64())})

    cells = pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(spectrum).cast("array<double>").alias("s"))
    every = pixels.sparkSession.range(0, lines, block).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(None).cast("array<double>").alias("s"))  # blocks without a pixel too
    both = every.unionByName(cells).withColumn("block", F.floor(F.col("row") / block))
    both.groupBy("block").applyInArrow(store, "n long").agg(F.sum("n")).collect()  # one number

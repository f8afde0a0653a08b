"""Watch a folder of pixel files and keep band statistics of what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_points(stream: DataFrame, ts: str, by: str, value: str, late: str = "12 hours") -> DataFrame:
    """Mean and count per hour and key; state older than ``late`` is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("hour"), by, "mean", "n")

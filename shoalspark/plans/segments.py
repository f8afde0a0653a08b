"""Segments as tables: labels, their boxes and outlines, spectra and scalars, written and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imageseg, outline, raster, segment, spectral

LAYERS = ("labels", "segments", "outlines", "spectra", "aux")


def layers(pixels: DataFrame, labels: DataFrame, spectrum: str, wavelengths: Sequence[float], scalars: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of labelled pixels: label raster, a row a segment (box, pixels), its rings, long spectra (median, MAD), scalars (medians)."""
    px = pixels.join(labels.select("row", "col", "seg_id"), ["row", "col"])
    live = px.where("seg_id <> 0")
    box = raster.bounds(live, "seg_id").join(live.groupBy("seg_id").agg(F.count("*").alias("n_pix")), "seg_id")
    return {
        "labels": labels.select("row", "col", "seg_id"), "segments": box, "outlines": outline.rings(live.select("row", "col", "seg_id")),
        "spectra": segment.band_stats(spectral.to_long(live, spectrum, wavelengths, ["seg_id"])),
        "aux": segment.scalar_stats(live, list(scalars)),
    }


def segment_and_export(pixels: DataFrame, features: Sequence[str], spectrum: str, wavelengths: Sequence[float], path: str, scalars: Sequence[str] = (), how: str = "graph", merge: float | None = None, **options) -> None:
    """Segment a scene, join like neighbours if asked for, renumber 1..N and write the tables."""
    labels = imageseg.segment(pixels, features, how, seams=how == "graph", **options)
    if merge is not None:
        merged = segment.merge_by_distance(pixels.select("row", "col", *features).join(labels, ["row", "col"]), features, merge)
        labels = merged.select("row", "col", F.col("merged_id").alias("seg_id"))
    else:
        labels = segment.relabel_dense(labels).select("row", "col", F.col("new_id").alias("seg_id"))
    write(pixels, labels, spectrum, wavelengths, path, scalars)


def write(pixels: DataFrame, labels: DataFrame, spectrum: str, wavelengths: Sequence[float], path: str, scalars: Sequence[str] = ()) -> None:
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    stored = pixels.sparkSession.read.parquet(f"{path}/labels")
    for name, table in layers(pixels, stored, spectrum, wavelengths, scalars).items():
        if name != "labels":
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{layer}")

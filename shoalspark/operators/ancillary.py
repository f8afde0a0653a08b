"""Ancillary fields of a scene from hourly global grids: meteorology and aerosol, by place and time.

A grid is a table (time, lat, lon, fields): one row a node and hour.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import physics as ph

#: The fields each grid must give.
MET_FIELDS = ("U10M", "V10M", "PS", "TQV", "TO3")
AER_FIELDS = ("TOTEXTTAU",)
SCALARS = ("wind_speed", "wind_direction", "surface_air_pressure", "water_vapor", "ozone", "aot550")


def bracketing(grid: DataFrame, times: DataFrame, ts: str = "ts") -> DataFrame:
    """Only the hours before and after a scene's time: an equi-join on the hour, which prunes a table stored by it."""
    low, high, _ = geo.bracket_hours(F.col(ts))
    hours = times.select(F.explode(F.array(low, high)).alias("time")).distinct()
    return grid.join(hours, "time", "left_semi")


def interpolate(points: DataFrame, grid: DataFrame, fields: Sequence[str], lat_axis: tuple[float, float], lon_axis: tuple[float, float], key: Sequence[str]) -> DataFrame:
    """``key`` and each field at a point's (lat, lon, ts): linear in place and time, NULL off the grid or where a node is missing.

    lat_axis, lon_axis: first node and step. The eight nodes of a point are found by equi-join on their indices.
    """
    low, high, w = geo.bracket_hours(F.col("ts"))
    u, v = (F.col("lat") - lat_axis[0]) / lat_axis[1], (F.col("lon") - lon_axis[0]) / lon_axis[1]
    p = points.select(*key, low.alias("t0"), high.alias("t1"), w.alias("wt"), u.alias("u"), v.alias("v"))
    bits = F.explode(F.array(*[F.struct(*[F.lit(b).alias(n) for b, n in zip((a, b, c), "abc")]) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    p = p.withColumn("k", bits)
    part = lambda b, x: F.when(b == 1, x).otherwise(1 - x)
    p = p.select(
        *key, F.when(F.col("k.a") == 1, F.col("t1")).otherwise(F.col("t0")).alias("time"),
        (F.floor("u") + F.col("k.b")).cast("int").alias("i"), (F.floor("v") + F.col("k.c")).cast("int").alias("j"),
        (part(F.col("k.a"), F.col("wt")) * part(F.col("k.b"), F.col("u") - F.floor("u")) * part(F.col("k.c"), F.col("v") - F.floor("v"))).alias("w"),
    ).where("w > 0")
    index = lambda c, axis: F.round((F.col(c) - axis[0]) / axis[1], 0).cast("int")
    g = grid.select("time", index("lat", lat_axis).alias("i"), index("lon", lon_axis).alias("j"), *fields)
    got = p.join(g, ["time", "i", "j"], "left").groupBy(*key)
    whole = lambda f: F.when(F.sum(F.when(F.col(f).isNotNull(), F.col("w"))) > 1 - 1e-9, F.sum(F.col("w") * F.col(f))).alias(f)
    return got.agg(*[whole(f) for f in fields])


def scene_scalars(points: DataFrame, met: DataFrame, aer: DataFrame, lat_axis: tuple[float, float], lon_axis: tuple[float, float], key: Sequence[str]) -> DataFrame:
    """Both grids at each scene's place and time, one row a scene, in the units of the correction. A scene that a field is missing for is an error."""
    fields = (*MET_FIELDS, *AER_FIELDS)
    both = interpolate(points, bracketing(met, points), MET_FIELDS, lat_axis, lon_axis, key).join(interpolate(points, bracketing(aer, points), AER_FIELDS, lat_axis, lon_axis, key), list(key))
    named = ph.ancillary(*[_needed(f) for f in fields])
    return both.select(*key, *[c.alias(n) for n, c in named.items()])


def _needed(field: str) -> Column:
    return F.coalesce(F.col(field), F.raise_error(F.lit(f"{field} is missing at a scene's place or time")).cast("double"))


def add_scalars(scenes: DataFrame, points: DataFrame, met: DataFrame, aer: DataFrame, lat_axis: tuple[float, float], lon_axis: tuple[float, float], key: str = "image_id") -> DataFrame:
    """``scenes`` with the scalars; those that are there stay, and scenes that have all are not looked up."""
    from ..sources.scene import fill_scalars

    here = [c for c in SCALARS if c in scenes.columns]
    lacks = F.lit(len(here) < len(SCALARS))
    for c in here:
        lacks = lacks | F.col(c).isNull()
    asked = points.join(scenes.where(lacks).select(key), key, "left_semi")
    return fill_scalars(scenes, scene_scalars(asked, met, aer, lat_axis, lon_axis, [key]), SCALARS, key)


def merged(met: Mapping[str, float], aer: Mapping[str, float]) -> dict[str, float]:
    """Two sets of scalars as one; a name in both must have one value."""
    clash = [k for k in met if k in aer and met[k] != aer[k]]
    if clash:
        raise ValueError(f"two values of {clash}")
    return {**met, **aer}

"""Affine grids, solar and viewing geometry, dates, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Affine = Sequence[float]  # a b c d e f: x = a col + b row + c, y = d col + e row + f
_E2 = (2 - 1 / 298.257223563) / 298.257223563  # squared eccentricity of WGS84
_OFFSETS = {"center": (0.5, 0.5), "ul": (0.0, 0.0), "ur": (1.0, 0.0), "ll": (0.0, 1.0), "lr": (1.0, 1.0)}


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def grid_xy(col: Column, row: Column, affine: Affine, at: str = "center") -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    dx, dy = _OFFSETS[at]
    return a * (col + dx) + b * (row + dy) + c, d * (col + dx) + e * (row + dy) + f


def grid_rowcol(x: Column, y: Column, affine: Affine) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return F.floor((a * (y - f) - d * (x - c)) / det), F.floor((e * (x - c) - b * (y - f)) / det)


def nearest_index(value: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest centre on a regular axis, held inside it."""
    return F.least(F.greatest(F.round((value - first) / step, 0).cast("int"), F.lit(0)), F.lit(n - 1))


def tile(row: Column, col: Column, size: int) -> tuple[Column, Column]:
    return F.floor(row / size).cast("int"), F.floor(col / size).cast("int")


# --- dates -------------------------------------------------------------------


def julian_day(ts: Column) -> Column:
    """Julian day of a UTC time (Meeus, 7.1)."""
    m = F.month(ts)
    y = F.when(m <= 2, F.year(ts) - 1).otherwise(F.year(ts))
    m = F.when(m <= 2, m + 12).otherwise(m)
    a = F.floor(y / 100)
    b = 2 - a + F.floor(a / 4)
    day = F.dayofmonth(ts) + F.hour(ts) / 24 + F.minute(ts) / 1440 + F.second(ts) / 86400
    return F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day + b - 1524.5


def bracket_hours(ts: Column) -> tuple[Column, Column, Column]:
    """The hour before, the hour after, and where between them the time lies (0..1)."""
    ts = ts.cast("timestamp")
    low = F.date_trunc("hour", ts)
    weight = (F.unix_micros(ts) - F.unix_micros(low)) / 3.6e9
    return low, low + F.expr("INTERVAL 1 HOUR"), weight


def relative_azimuth(view: Column, sun: Column, fold: bool = False) -> Column:
    d = F.abs(view - sun)
    return F.when(d > 180, 360 - d).otherwise(d) if fold else d


def local_time(ts: Column, zone: str) -> Column:
    """The clock of a named zone at a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def zone_longitude(ts: Column, zone: str) -> Column:
    """Central longitude of the zone's clock at that time: 15 degrees an hour."""
    return (F.unix_seconds(local_time(ts, zone).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))) / 3600 * 15


def extent_affine(pixels: DataFrame) -> DataFrame:
    """Affine whose corners are the outer pixel centres, a row: the cells shrink by their share of a pixel."""
    e = pixels.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.max("col") - F.min("col") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"))
    return e.select(F.array((F.col("x1") - F.col("x0")) / F.col("w"), F.lit(0.0), F.col("x0"), F.lit(0.0), (F.col("y0") - F.col("y1")) / F.col("h"), F.col("y1")).alias("affine"))


def refreshed(pixels: DataFrame) -> DataFrame:
    """A crop's axes, a row: sizes, extents and the affine of its corner, half a pixel out from the first centres."""
    e = pixels.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))], F.count_distinct("col").alias("width"), F.count_distinct("row").alias("height"))
    dx, dy = (F.try_divide(F.col(f"{c}_max") - F.col(f"{c}_min"), F.col(n) - 1) for c, n in (("x", "width"), ("y", "height")))
    return e.withColumn("affine", F.array(dx, F.lit(0.0), F.col("x_min") - dx / 2, F.lit(0.0), -dy, F.col("y_max") + dy / 2))


# --- sun -----------------------------------------------------------------------


def with_sun_position(df: DataFrame, ts: str, lat: str, lon: str, utc_offset: float = 0.0, zenith: str = "sun_zenith", azimuth: str = "sun_azimuth", valid: Column | None = None) -> DataFrame:
    """Add solar zenith and azimuth (degrees) by the NOAA equations; ``ts`` is the clock of ``utc_offset``.

    With ``valid`` they are NULL where it does not hold (a missing one does not).

    In steps of one projection each: later terms use earlier ones many times,
    and one nested expression of them would be recomputed as often.
    """
    x = lambda k: F.col(f"__{k}")
    inside = lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))
    cols = df.columns
    df = df.withColumn("__valid", F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    df = df.withColumn("__t", (julian_day(F.col(ts)) - 2451545.0) / 36525)
    t = x("t")
    df = df.withColumns({
        "__l": F.pmod(280.46645 + 36000.76983 * t + 0.0003032 * t * t, F.lit(360.0)),
        "__m": 357.52910 + 35999.05030 * t - 0.0001559 * t * t - 0.00000048 * t * t * t,
        "__e": 0.016708617 - 0.000042037 * t - 0.0000001236 * t * t,
        "__o": F.radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60),
    })
    l0, m, e, o = x("l"), x("m"), x("e"), x("o")
    centre = (1.914600 - 0.004817 * t - 0.000014 * t * t) * sind(m) + (0.019993 - 0.000101 * t) * sind(2 * m) + 0.000290 * sind(3 * m)
    df = df.withColumns({"__s": l0 + centre - 0.00569 - 0.00478 * sind(125.04452 - 1934.136261 * t), "__y": F.tan(o / 2) * F.tan(o / 2)})
    y = x("y")
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    eot = 4 * F.degrees(y * sind(2 * l0) - 2 * e * sind(m) + 4 * e * y * sind(m) * cosd(2 * l0) - 0.5 * y * y * sind(4 * l0) - 1.25 * e * e * sind(2 * m))
    df = df.withColumns({"__d": F.asin(F.sin(o) * sind(x("s"))), "__h": F.pmod(minutes + eot + 4 * F.col(lon) - 60 * utc_offset, F.lit(1440.0)) / 4 - 180})
    la, d, h = F.col(lat), x("d"), x("h")
    df = df.withColumn("__z", F.acos(inside(sind(la) * F.sin(d) + cosd(la) * F.cos(d) * cosd(h))))
    z = x("z")
    df = df.withColumn("__a", F.degrees(F.acos(inside(F.try_divide(sind(la) * F.cos(z) - F.sin(d), cosd(la) * F.sin(z))))))
    turned = F.pmod(F.when(h > 0, x("a") + 180).otherwise(540 - x("a")), F.lit(360.0))
    return df.select(*[F.col(f"`{c}`") for c in cols], F.when(x("valid"), F.degrees(z)).alias(zenith), F.when(x("valid"), turned).alias(azimuth))


def hour_angle(lon: Column, zone_lon: Column, ts: Column) -> Column:
    hours = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600 + (lon - zone_lon) * 240 / 3600
    return (hours - 12) * 15


def declination(ts: Column, unit: str = "degrees") -> Column:
    """Solar declination in degrees, or in radians as the series gives it (Spencer's)."""
    b = 2 * math.pi * (F.dayofyear(ts) - 1) / 365
    d = (0.006918 - 0.399912 * F.cos(b) + 0.070257 * F.sin(b) - 0.006758 * F.cos(2 * b) + 0.000907 * F.sin(2 * b) - 0.002697 * F.cos(3 * b) + 0.00148 * F.sin(3 * b))
    return d if unit == "radians" else F.degrees(d)


def sun_from_hour_angle(lat: Column, hour: Column, decl: Column, unit: str = "degrees") -> tuple[Column, Column]:
    """Zenith and azimuth in degrees; ``unit``: of the declination.

    At noon the azimuth's cosine is 1 but for its last bit, and NaN beyond 1: a declination turned to degrees and back decides otherwise.
    """
    d = decl if unit == "radians" else F.radians(decl)
    s = sind(lat) * F.sin(d) + cosd(lat) * F.cos(d) * cosd(hour)
    c = F.cos(F.asin(s))
    azimuth = F.degrees(F.acos((s * sind(lat) - F.sin(d)) / (c * cosd(lat)))) + 180
    return 90 - F.degrees(F.asin(s)), azimuth


# --- sensor ---------------------------------------------------------------------


def view_angles(sample: Column, samples: int, resolution: float, height: float, heading: float, roll: float = 0.0) -> tuple[Column, Column]:
    """View zenith and azimuth of a push-broom sample (0-based)."""
    nadir = samples / 2 * resolution - height * math.tan(math.radians(roll))
    zenith = F.degrees(F.atan(F.abs(nadir - (sample * resolution + resolution / 2)) / height))
    left, right = (heading % 360 + 90) % 360, (heading % 360 - 90) % 360
    return zenith, F.when(sample < int(nadir / resolution), F.lit(left)).otherwise(F.lit(right))


# --- map projection ---------------------------------------------------------------


def tm_forward(lat: Column, lon: Column, lon0: float, k0: float = 0.9996, x0: float = 500000.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Transverse Mercator on WGS84 (Krueger series to the third order)."""
    n, radius, alpha, _ = _krueger()
    e = math.sqrt(1 - ((1 - n) / (1 + n)) ** 2)
    s = sind(lat)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x0 + k0 * radius * x, y0 + k0 * radius * y


def tm_inverse(x: Column, y: Column, lon0: float, k0: float = 0.9996, x0: float = 500000.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude of projected coordinates."""
    n, radius, _, beta = _krueger()
    e = math.sqrt(1 - ((1 - n) / (1 + n)) ** 2)
    xi, eta = (y - y0) / (k0 * radius), (x - x0) / (k0 * radius)
    a, b = xi, eta
    for j, c in enumerate(beta, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    q = F.atanh(F.sin(chi))
    phi = F.tanh(q)  # sine of latitude, by fixed-point rounds that converge with e squared
    for _ in range(4):
        phi = F.tanh(q + e * F.atanh(e * phi))
    return F.degrees(F.asin(phi)), lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def meridian_arc(lat: Column) -> Column:
    """Metres along a meridian of WGS84 from the equator (series in the squared eccentricity, to its third power)."""
    e2 = _E2
    c = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    p = F.radians(lat)
    return 6378137.0 * (c[0] * p - c[1] * F.sin(2 * p) + c[2] * F.sin(4 * p) - c[3] * F.sin(6 * p))


def parallel_arc(lat: Column, degrees: Column) -> Column:
    """Metres along a parallel of WGS84."""
    return 6378137.0 * cosd(lat) / F.sqrt(1 - _E2 * sind(lat) * sind(lat)) * F.radians(degrees)


def _krueger() -> tuple[float, float, list[float], list[float]]:
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, alpha, beta

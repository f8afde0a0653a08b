"""Dark spectrum and aerosol retrieval from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectral import exact_quantile

GEOMETRY = ("sun_zenith", "view_zenith", "relative_azimuth")


def _clean(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def dark_min(long: DataFrame, geometry: tuple[str, ...] = ()) -> DataFrame:
    """Per band the least value, and the geometry of the pixel that has it (the first pixel on ties)."""
    first = F.struct("value", "pixel")
    return _clean(long).groupBy("wavelength").agg(F.min("value").alias("rho_dark"), *[F.min_by(g, first).alias(g) for g in geometry])


def dark_percentile(long: DataFrame, percent: float = 1.0, geometry: tuple[str, ...] = ()) -> DataFrame:
    """Per band the exact percentile; geometry of the first pixel that equals it, NULL if none does."""
    q = exact_quantile(_clean(long), ["wavelength"], "value", percent / 100, "rho_dark")
    if not geometry:
        return q
    same = _clean(long).join(q, "wavelength").where(F.col("value") == F.col("rho_dark"))
    at = same.groupBy("wavelength").agg(*[F.min_by(g, "pixel").alias(g) for g in geometry])
    return q.join(at, "wavelength", "left")


def dark_ols(long: DataFrame, n: int = 1001) -> DataFrame:
    """Per band the intercept of the ``n`` least values against their rank.

    The rank is a top-k within the band: WindowGroupLimit keeps ``n`` rows of each task before the shuffle.
    """
    w = Window.partitionBy("wavelength").orderBy("value")
    top = _clean(long).select("wavelength", "value").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    x, y = F.col("rank") - 1, F.col("value")
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return top.groupBy("wavelength").agg((F.avg(y) - slope * F.avg(x)).alias("rho_dark"), F.count("*").alias("n"))


def invert_aod(dark: DataFrame, path: DataFrame) -> DataFrame:
    """Per band the AOD whose path reflectance is the dark one; NULL outside the table.

    path: (wavelength, aod, rho_path), monotone in aod at each wavelength.
    """
    w = Window.partitionBy("wavelength").orderBy("rho_path")
    seg = path.select("wavelength", F.col("aod").alias("a0"), F.col("rho_path").alias("r0"), F.lead("aod").over(w).alias("a1"), F.lead("rho_path").over(w).alias("r1")).where("a1 is not null")
    inside = (F.col("rho_dark") >= F.col("r0")) & (F.col("rho_dark") <= F.col("r1"))
    a = F.col("a0") + (F.col("rho_dark") - F.col("r0")) * F.try_divide(F.col("a1") - F.col("a0"), F.col("r1") - F.col("r0"))
    found = dark.join(seg, "wavelength").where(inside).groupBy("wavelength").agg(F.min(a).alias("aod"))
    return dark.join(found, "wavelength", "left")


def scene_aod(inverted: DataFrame) -> DataFrame:
    """Median over the bands (a hundred rows, whatever the scene)."""
    return inverted.agg(F.median("aod").alias("aod550"), F.count("aod").alias("n_bands"))


def stretch(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99, out: str = "stretched") -> DataFrame:
    """Clip to two exact percentiles of the valid values and scale to 0..1; the limits are one row."""
    a, b = exact_quantile(df, [], value, lo, "__lo"), exact_quantile(df, [], value, hi, "__hi")
    limits = F.broadcast(a.crossJoin(b))  # one row
    clipped = F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi"))
    return df.crossJoin(limits).withColumn(out, (clipped - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-12)).drop("__lo", "__hi")

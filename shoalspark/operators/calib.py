"""Vicarious calibration: per-wavelength fits on matchups, their application and files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spectral import exact_quantile, interpolate

#: Fitters by model name; more can be registered.
MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {}
MEANS = "rho_t_hat", "rho_t"


def register(name: str):
    def keep(fit):
        MODELS[name] = fit
        return fit

    return keep


def fit(name: str, matchups: DataFrame) -> DataFrame:
    if name not in MODELS:
        raise ValueError(f"no calibration model {name}: {sorted(MODELS)}")
    return MODELS[name](matchups)


def _paired(m: DataFrame) -> DataFrame:
    good = [F.col(c).isNotNull() & ~F.isnan(c) for c in MEANS]
    return m.where(good[0] & good[1])


@register("ratio")
def ratio(m: DataFrame) -> DataFrame:
    """gain = exact median of predicted over observed; gain_std (population); n."""
    g = _paired(m).where("rho_t <> 0").select("wavelength", (F.col("rho_t_hat") / F.col("rho_t")).alias("g"))
    spread = g.groupBy("wavelength").agg(F.stddev_pop("g").alias("gain_std"), F.count("g").alias("n"))
    return exact_quantile(g, ["wavelength"], "g", 0.5, "gain").join(spread, "wavelength")


def _moments(m: DataFrame) -> DataFrame:
    x, y = F.col("rho_t"), F.col("rho_t_hat")
    return _paired(m).groupBy("wavelength").agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy")
    ).where("n >= 2")


def _r2() -> Column:
    return F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy"))


@register("ols")
def ols(m: DataFrame) -> DataFrame:
    a = F.try_divide(F.col("cxy"), F.col("vx"))
    return _moments(m).select("wavelength", a.alias("a"), (F.col("my") - a * F.col("mx")).alias("b"), _r2().alias("r2"), "n")


@register("sma")
def sma(m: DataFrame) -> DataFrame:
    """Reduced major axis: the slope's sign is the correlation's."""
    a = F.signum("cxy") * F.sqrt(F.try_divide(F.col("vy"), F.col("vx")))
    return _moments(m).select("wavelength", a.alias("a"), (F.col("my") - a * F.col("mx")).alias("b"), _r2().alias("r2"), "n")


def summary(m: DataFrame) -> DataFrame:
    d = F.col("rho_t_hat") - F.col("rho_t")
    return m.groupBy("wavelength").agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("rho_t").alias("n"))


def metadata(m: DataFrame, coefficients: DataFrame) -> DataFrame:
    """One row: distinct ids and images, pixels, and the range of gains or the mean r2."""
    ids = m.agg(F.count_distinct("uuid").alias("n_uuid"), F.count_distinct("image_name").alias("n_image"), F.count("*").alias("n_pixels"))
    if "gain" in coefficients.columns:
        of = coefficients.agg(F.min("gain").alias("gain_min"), F.max("gain").alias("gain_max"))
    else:
        of = coefficients.agg(F.avg("r2").alias("r2_mean"))
    return ids.crossJoin(of)  # one row each


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply(df: DataFrame, coefficients: DataFrame, value: str = "rho_t", out: str = "rho_cal") -> DataFrame:
    """Calibrated values of a long table with a wavelength column: gain * rho or a * rho + b."""
    gain = "gain" in coefficients.columns
    c = coefficients.select("wavelength", *(["gain"] if gain else ["a", "b"]))
    joined = df.join(c, "wavelength", "left")
    return joined.withColumn(out, F.col(value) * F.col("gain") if gain else F.col("a") * F.col(value) + F.col("b")).drop("gain", "a", "b")


def align(coefficients: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """Coefficients at a sensor's wavelengths by linear interpolation, NULL outside the fitted range."""
    out = wavelengths
    for c in [c for c in ("gain", "a", "b") if c in coefficients.columns]:
        out = interpolate(out, "wavelength", coefficients, "wavelength", c, c)
    return out


def gain_lookup(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Join on whole-number wavelengths; the first gain of a number wins; a missing one is an error."""
    g = gains.withColumn("key", F.col("wavelength").cast("int")).groupBy("key").agg(F.min_by("gain", "wavelength").alias("gain"))
    out = df.withColumn("key", F.col("wavelength").cast("int")).join(g, "key", "left").drop("key")
    return out.withColumn("gain", F.coalesce("gain", F.raise_error(F.concat(F.lit("no gain at "), F.col("wavelength").cast("string")))))


# --- files ------------------------------------------------------------------------


def save(coefficients: DataFrame, path: str, name: str, meta: dict | None = None) -> None:
    """A commented CSV; coefficients are one row a band."""
    rows = coefficients.orderBy("wavelength").toPandas()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# model_name: {name}\n# metadata: {json.dumps(meta or {}, sort_keys=True)}\n")
        rows.to_csv(f, index=False)


def load(spark: SparkSession, path: str) -> tuple[str | None, dict, DataFrame]:
    """(model name, metadata, coefficients); a file without a header is told by its columns."""
    name, meta = None, {}
    for line in spark.read.text(path).where(F.col("value").startswith("#")).limit(20).collect():
        key, _, value = line[0].lstrip("# ").partition(":")
        if key == "model_name":
            name = value.strip()
        elif key == "metadata":
            meta = json.loads(value)
    df = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    df = df.select(*[F.col(c).cast("double").alias(c.strip().lower()) for c in df.columns])
    return name or ("ratio" if "gain" in df.columns else "sma" if "a" in df.columns else None), meta, df


def save_data(matchups: DataFrame, path: str) -> None:
    matchups.write.mode("overwrite").parquet(path)


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """Stored matchups; the columns that the fits need must be there."""
    df = spark.read.parquet(path)
    missing = [c for c in ("uuid", "image_name", "wavelength", *MEANS) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df


def calibrate(df: DataFrame, coefficients: DataFrame, name: str, value: str = "rho_t", level: str = "L1R") -> DataFrame:
    """apply(), the value replaced, with the product's level and the model it was made by."""
    return apply(df, coefficients, value, "__cal").withColumn(value, F.col("__cal")).drop("__cal").withColumns({"level": F.lit(level), "calibration": F.lit(name)})

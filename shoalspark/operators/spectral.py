"""Band views, band selection, one-dimensional interpolation and exact quantiles."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(df: DataFrame, spectrum: str, wavelengths: Sequence[float], keep: Sequence[str], value: str = "value") -> DataFrame:
    """One row a band: keep, wl_idx, wavelength, value."""
    wl = F.array(*[F.lit(float(w)) for w in wavelengths])
    return df.select(*keep, F.posexplode(spectrum).alias("wl_idx", value)).withColumn("wavelength", F.get(wl, F.col("wl_idx")))


def to_cube(long: DataFrame, keep: Sequence[str], value: str = "value", spectrum: str = "spectrum") -> DataFrame:
    """Bands back to one spectrum a pixel, in wavelength order."""
    return long.groupBy(*keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("wavelength", F.col(value).alias("v")))), lambda x: x["v"]).alias(spectrum))


def unpivot_bands(df: DataFrame, keep: Sequence[str], prefix: str = r".*_(\d{3})") -> DataFrame:
    """Wide band columns, whose names end in a three-digit wavelength, to rows."""
    import re

    bands = [(c, float(m[1])) for c in df.columns if c not in keep and (m := re.fullmatch(prefix, c))]
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(w).alias("wavelength"), F.col(c).cast("double").alias("value")) for c, w in bands])).alias("b")).select(*keep, "b.*")


def pivot_bands(long: DataFrame, keep: Sequence[str], wavelengths: Sequence[float], value: str = "value", name=lambda w: f"m_{w:g}".replace(".", "_")) -> DataFrame:
    """One column a wavelength: conditional aggregates, so one shuffle whatever the bands."""
    return long.groupBy(*keep).agg(*[F.first(F.when(F.col("wavelength") == w, F.col(value)), ignorenulls=True).alias(name(w)) for w in wavelengths])


def nearest_band(wavelengths: Sequence[float], target: float) -> int:
    """First index of least distance."""
    return min(range(len(wavelengths)), key=lambda i: (abs(wavelengths[i] - target), i))


def mask_wavelength(wavelengths: Sequence[float], limits: Sequence[float]) -> list[int]:
    """Indices inside the closed range of ``limits``."""
    return [i for i, w in enumerate(wavelengths) if min(limits) <= w <= max(limits)]


def take_bands(spectrum: Column | str, indices: Sequence[int]) -> Column:
    s = F.col(spectrum) if isinstance(spectrum, str) else spectrum
    if indices and list(indices) == list(range(indices[0], indices[-1] + 1)):
        return F.slice(s, indices[0] + 1, len(indices))
    return F.array(*[F.get(s, F.lit(i)) for i in indices])


def good_bands(flags: Sequence[int], contiguous: bool = False) -> list[int]:
    """Indices flagged 1; ``contiguous`` takes all between the first and the last of them."""
    good = [i for i, f in enumerate(flags) if f == 1]
    return list(range(good[0], good[-1] + 1)) if contiguous and good else good


# --- interpolation ---------------------------------------------------------------


def segments(nodes: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive nodes as (x0, x1, y0, y1)."""
    w = Window.partitionBy(*by).orderBy(x) if by else Window.partitionBy(F.lit(0)).orderBy(x)
    return nodes.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))


def literal_interp(x: Column, xs: Sequence[float], ys: Sequence[float], outside: str = "null") -> Column:
    """Interpolation in a small table of literals; outside: null, flat, or error."""
    pairs = sorted(zip(map(float, xs), map(float, ys)))
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in zip(pairs, pairs[1:]):
        out = F.when((x >= x0) & (x <= x1), y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    (xa, ya), (xb, yb) = pairs[0], pairs[-1]
    if outside == "flat":
        return F.when(x < xa, F.lit(ya)).when(x > xb, F.lit(yb)).otherwise(out)
    if outside == "error":
        return F.when((x < xa) | (x > xb), F.raise_error(F.concat(F.lit("outside the table: "), x.cast("string")))).otherwise(out)
    return out


def resampled(x: Column | str, y: Column | str, wavelengths: Sequence[float]) -> Column:
    """Spectra (arrays of wavelengths, in any order, and of values) at a sensor's wavelengths, linear between nodes and held at the ends.

    In Arrow batches: a search for each band by functions of array elements takes some hundred times as long. NULL
    without nodes; a band beside a missing value is missing.
    """
    target = np.array(wavelengths, float)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        groups: dict[tuple, list[int]] = {}  # spectra of one instrument share their nodes
        for i, nodes in enumerate(x.to_pylist()):
            groups.setdefault(None if nodes is None else tuple(nodes), []).append(i)
        found, there = np.full((len(x), len(target)), np.nan), np.zeros(len(x), bool)
        for nodes, at in groups.items():
            if not nodes:
                continue
            some = y.take(pa.array(at))
            ok = np.flatnonzero(~some.is_null().to_numpy(zero_copy_only=False))
            at, there[np.array(at)[ok]] = np.array(at)[ok], True
            values = some.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), len(nodes))
            nodes = np.array(nodes, float)
            order = np.argsort(nodes, kind="stable")
            nodes, values = nodes[order], values[:, order]
            plain = np.isfinite(values).all(axis=1) & np.isfinite(nodes).all()
            for i in np.flatnonzero(~plain):
                found[at[i]] = np.interp(target, nodes, values[i])
            if plain.any():
                share = np.stack([np.interp(target, nodes, e) for e in np.eye(len(nodes))]) if (np.diff(nodes) > 0).all() else None
                found[at[plain]] = values[plain] @ share if share is not None else np.stack([np.interp(target, nodes, v) for v in values[plain]])
        flat = found.ravel()
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(target))
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=np.isnan(flat)), mask=pa.array(~there))

    return run(x, y)


def interpolate(df: DataFrame, x: str, nodes: DataFrame, node_x: str, node_y: str, out: str, outside: str = "null", by: Sequence[str] = (), bin_width: float | None = None) -> DataFrame:
    """Left join to the bracketing nodes; with ``bin_width`` an equi-join on bins, for tables too large for a range join.

    outside: "null" or "flat" (the end values are held).
    """
    seg = segments(nodes, node_x, node_y, by)
    if outside == "flat":
        ends = nodes.groupBy(*by).agg(F.min(node_x).alias("xa"), F.max(node_x).alias("xb"), F.min_by(node_y, node_x).alias("ya"), F.max_by(node_y, node_x).alias("yb"))
        df = df.join(ends, list(by), "left") if by else df.crossJoin(F.broadcast(ends))  # one row
        df = df.withColumn("__x", F.least(F.greatest(F.col(x), "xa"), "xb"))
    else:
        df = df.withColumn("__x", F.col(x))
    left, right = df.alias("l"), seg.where("x1 is not null").alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by]
    # half-open, so that a node's value is found once; the last node closes its segment
    last = Window.partitionBy(*(by or [F.lit(0)]))
    right = right.withColumn("__end", F.col("x1") == F.max("x1").over(last)).alias("r")
    on.append((F.col("l.__x") >= F.col("r.x0")) & ((F.col("l.__x") < F.col("r.x1")) | (F.col("r.__end") & (F.col("l.__x") == F.col("r.x1")))))
    if bin_width:
        left = left.withColumn("__bin", F.floor(F.col("__x") / bin_width)).alias("l")
        right = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("x0") / bin_width), F.floor(F.col("x1") / bin_width)))).alias("r")
        on.append(F.col("l.__bin") == F.col("r.__bin"))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    value = F.col("r.y0") + (F.col("l.__x") - F.col("r.x0")) * F.try_divide(F.col("r.y1") - F.col("r.y0"), F.col("r.x1") - F.col("r.x0"))
    joined = left.join(right, cond, "left")
    keep = [F.col(f"l.`{c}`") for c in df.columns if c not in ("__x", "xa", "xb", "ya", "yb")]
    return joined.select(*keep, value.alias(out))


def covariance(pixels: DataFrame, spectrum: str, bands: int) -> DataFrame:
    """(i, j, cov) of a spectrum's bands, i <= j, over all pixels that have both; zero for a single one.

    A first pass takes the bands' means, a second the products of what is left, in Arrow batches: each task sends one
    row a pair of bands, whatever its pixels. NULL and NaN are missing.
    """
    value = lambda k: F.get(F.col(spectrum), F.lit(k)).cast("double")
    means = pixels.agg(*[F.avg(F.when(~F.isnan(value(k)), value(k))) for k in range(bands)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    i, j = np.triu_indices(bands)

    def moments(batches):
        n, sx, sy, sxy = np.zeros((4, bands, bands))
        for b in batches:
            rows = [r for r in b.column("s").to_pylist() if r is not None]
            if not rows:
                continue
            x = np.array([[np.nan if v is None else v for v in (list(r) + [None] * bands)[:bands]] for r in rows], float) - shift
            ok = (~np.isnan(x)).astype(float)
            x = np.where(ok > 0, x, 0.0)
            n, sx, sy, sxy = n + ok.T @ ok, sx + x.T @ ok, sy + ok.T @ x, sxy + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(m[i, j]) for m in (n, sx, sy, sxy))], names=["i", "j", "n", "sx", "sy", "sxy"])

    parts = pixels.select(F.col(spectrum).cast("array<double>").alias("s")).mapInArrow(moments, "i int, j int, n double, sx double, sy double, sxy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    cov = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.col("n") - 1)
    return total.select("i", "j", F.coalesce(cov, F.lit(0.0)).alias("cov"))


# --- exact quantiles ------------------------------------------------------------


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.5, out: str = "quantile", accuracy: int = 20_000) -> DataFrame:
    """Exact quantile with linear interpolation for groups of any size, in two passes.

    A group's percentile buffer holds each of its distinct values. Here a sketch
    (merged in each task before the shuffle) brackets the two ranks asked for by
    ``accuracy``'s error; the second pass counts what lies below the bracket and
    the distinct values inside it, and only those are ordered. Groups up to
    ``accuracy`` values are ordered whole. NULL and NaN values are left out.
    Groups without a value give no row.
    """
    keys = list(by)
    v = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    margin = 3 / accuracy
    sketch = F.percentile_approx("v", [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    ends = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch.alias("b"))
    whole = F.col("n") <= accuracy
    ends = ends.select(*keys, "n", F.when(whole, F.col("lo")).otherwise(F.col("b")[0]).alias("lo"), F.when(whole, F.col("hi")).otherwise(F.col("b")[1]).alias("hi"))
    near = _join(v, ends, keys).where("v <= hi").groupBy(*keys, "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("m"))
    inside = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("v").asc_nulls_first())
    near = near.withColumn("first", F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    rank = F.lit(q) * (F.col("n") - 1)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("first") + F.col("m") > r), F.col("v")))
    picked = near.groupBy(*keys, "n").agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"))
    return picked.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias(out))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})  # NULL is a group like others
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(right, functools.reduce(lambda a, b: a & b, same)).drop(*[f"__k_{k}" for k in keys])

"""Segment statistics, relabelling, adjacency and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, shared_folder
from .spectral import exact_quantile


def band_stats(long: DataFrame, seg: str = "seg_id", wl: str = "wavelength", value: str = "value") -> DataFrame:
    """Exact median and unscaled MAD of each segment's band, for segments of any size; label 0 is masked."""
    good = long.where((F.col(seg) != 0) & F.col(value).isNotNull() & ~F.isnan(value)).select(seg, wl, F.col(value).cast("double").alias("v"))
    med = exact_quantile(good, [seg, wl], "v", 0.5, "rho_med")
    off = good.join(med, [seg, wl]).select(seg, wl, F.abs(F.col("v") - F.col("rho_med")).alias("d"))
    return med.join(exact_quantile(off, [seg, wl], "d", 0.5, "rho_mad"), [seg, wl])


def scalar_stats(pixels: DataFrame, medians: Sequence[str], spread: Sequence[str] = (), seg: str = "seg_id") -> DataFrame:
    """Pixels, medians (exact, for segments of any size) and population standard deviations per segment."""
    p = pixels.where(F.col(seg) != 0)
    out = p.groupBy(seg).agg(F.count("*").cast("int").alias("n_pix"), *[F.stddev_pop(c).alias(f"{c}_sd") for c in spread])
    for c in medians:
        out = out.join(exact_quantile(p, [seg], c, 0.5, f"{c}_med"), seg, "left")
    return out.select(seg, "n_pix", *[f"{c}_med" for c in medians], *[f"{c}_sd" for c in spread])


def mean_features(pixels: DataFrame, features: Sequence[str], seg: str = "seg_id") -> DataFrame:
    return pixels.where(F.col(seg) != 0).groupBy(seg).agg(F.count("*").alias("n_pix"), *[F.avg(c).alias(c) for c in features])


def ordinals(values: DataFrame, column: str, out: str) -> DataFrame:
    """1..N of distinct values in ascending order: counted in ranges of the order, each moved by what stands before it."""
    cut = values.select(column).distinct()
    cut = materialize(cut.repartitionByRange(column).withColumn("__range", F.spark_partition_id()), "ordinals")
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")  # a row a range
    here = F.row_number().over(Window.partitionBy("__range").orderBy(column))
    return cut.withColumn("__here", here).join(sizes, "__range").select(column, (F.col("__here") + F.col("__before")).cast("int").alias(out))


def relabel_dense(df: DataFrame, seg: str = "seg_id", out: str = "new_id") -> DataFrame:
    """1..N by ascending label, 0 kept. The rank is taken over distinct labels only."""
    return df.join(ordinals(df.where(F.col(seg) != 0), seg, out), seg, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def adjacency(pixels: DataFrame, seg: str = "seg_id") -> DataFrame:
    """Unordered pairs of different non-zero labels that touch right or below: equi-joins on shifted cells."""
    p = pixels.where(F.col(seg) != 0).select("row", "col", F.col(seg).alias("s"))
    shifted = p.select(F.col("row"), (F.col("col") - 1).alias("col"), F.col("s").alias("t")).unionByName(p.select((F.col("row") - 1).alias("row"), F.col("col"), F.col("s").alias("t")))
    pairs = p.join(shifted, ["row", "col"]).where("s <> t")
    return pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def connected(edges: DataFrame, nodes: DataFrame, node: str = "node", rounds: int = 50) -> DataFrame:
    """(node, root): least node reachable, by neighbour minima and pointer jumps, checkpointed each round."""
    shared_folder(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = nodes.select(F.col(node).alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    for _ in range(rounds):
        low = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("low"))
        step = label.join(low, label["node"] == low["a"], "left").select("node", F.least("root", F.coalesce("low", "root")).alias("new"), "root")
        jump = step.select(F.col("node").alias("j"), F.col("new").alias("to"))
        new = step.join(jump, step["new"] == jump["j"]).select("node", F.least("new", "to").alias("root"), F.col("root").alias("old")).checkpoint()
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")
    raise RuntimeError("components did not settle")


def merge_by_distance(pixels: DataFrame, features: Sequence[str], threshold: float, passes: int = 3, seg: str = "seg_id") -> DataFrame:
    """Merge touching segments whose normalised mean features are within ``threshold``, until none or ``passes``.

    Per pass: means (map-side combined), neighbour pairs, components of the close
    pairs, and a join of the new labels to the pixels.
    """
    cur = pixels
    for _ in range(passes):
        means = mean_features(cur, features, seg)
        norm = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
        unit = means.select(F.col(seg).alias("s"), *[F.try_divide(F.col(f), norm).alias(f) for f in features])
        pairs = adjacency(cur, seg)
        left = unit.select(F.col("s").alias("a"), *[F.col(f).alias(f"{f}_a") for f in features])
        right = unit.select(F.col("s").alias("b"), *[F.col(f).alias(f"{f}_b") for f in features])
        d2 = sum(((F.col(f"{f}_a") - F.col(f"{f}_b")) * (F.col(f"{f}_a") - F.col(f"{f}_b")) for f in features), F.lit(0.0))
        close = pairs.join(left, "a").join(right, "b").where(F.sqrt(d2) <= threshold).select("a", "b")
        roots = connected(close, unit, "s")
        if roots.where("root <> node").isEmpty():
            break
        cur = cur.join(roots.select(F.col("node").alias(seg), "root"), seg, "left").withColumn(seg, F.coalesce("root", F.lit(0).cast("long"))).drop("root")
    return relabel_dense(cur, seg, "merged_id")


def dissolve(polygons: DataFrame, seg: str = "seg_id") -> DataFrame:
    """One row a segment: n_pix of its parts summed, other columns the first by part."""
    others = [c for c in polygons.columns if c not in (seg, "n_pix", "part")]
    return polygons.groupBy(seg).agg(F.sum("n_pix").alias("n_pix"), *[F.min_by(c, "part").alias(c) for c in others])


def mixture_prior(library: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Equal-weight mixture moments of the classes at each wavelength (columns r_b_mean, r_b_sd)."""
    m, s = F.col("r_b_mean"), F.col("r_b_sd")
    out = library.groupBy("wavelength").agg(F.avg(m).alias("mu"), F.avg(s * s + m * m).alias("second"))
    return out.select("wavelength", "mu", F.sqrt(F.greatest(F.col("second") - F.col("mu") * F.col("mu"), F.lit(floor))).alias("sd"))


def replicate_ids(df: DataFrame, order: str, by: str = "class", wl: str = "wavelength") -> DataFrame:
    """A new replicate starts where the wavelength falls, in the given row order."""
    w = Window.partitionBy(by).orderBy(order)
    fall = F.when(F.col(wl) < F.lag(wl).over(w), 1).otherwise(0)
    return df.withColumn("__fall", fall).withColumn("replicate", F.sum("__fall").over(w) + 1).drop("__fall")


def median_fill(df: DataFrame, value: str, by: str = "wavelength") -> DataFrame:
    """Missing values take the median of their wavelength."""
    clean = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    med = exact_quantile(df.select(by, clean.alias("__v")), [by], "__v", 0.5, "__m")
    return df.join(med, by, "left").withColumn(value, F.coalesce(clean, "__m")).drop("__m")


def row_counts(df: DataFrame, seg: str = "seg_id") -> DataFrame:
    return df.groupBy(seg).count().agg(F.min("count").alias("least"), F.median("count").alias("median"), F.max("count").alias("most"))

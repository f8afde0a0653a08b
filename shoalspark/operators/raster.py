"""Neighbourhood operators on (row, col) tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def tile_assign(pixels: DataFrame, size: int) -> DataFrame:
    return pixels.withColumns({"tile_y": F.floor(F.col("row") / size).cast("int"), "tile_x": F.floor(F.col("col") / size).cast("int")})


def tile_union(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Bounding box of two tiles (row0, row1, col0, col1)."""
    return min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])


def tile_grow(t: tuple[int, int, int, int], by: int) -> tuple[int, int, int, int]:
    """Each side moved out (or, with a negative number, in)."""
    return t[0] - by, t[1] + by, t[2] - by, t[3] + by


def fill_gaps(pixels: DataFrame, value: str, out: str = "filled") -> DataFrame:
    """Forward along rows, down columns, backward along rows, down columns again."""
    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    past, ahead = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    x = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    df = pixels.withColumn(out, x)
    for w, f, frame in ((row, F.last, past), (col, F.last, past), (row, F.first, ahead), (col, F.last, past)):
        df = df.withColumn(out, f(out, ignorenulls=True).over(w.rowsBetween(*frame)))
    return df


def kernel(sigma: float, truncate: float = 3.0) -> list[tuple[int, float]]:
    """(offset, weight) of a one-dimensional Gaussian, weights of sum 1."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def _blurred(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A grid convolved along rows and columns; beyond its edges there is nothing."""
    for axis in (0, 1):
        r = len(weights) // 2
        padded = np.pad(grid, [(r, r) if k == axis else (0, 0) for k in (0, 1)])
        n = grid.shape[axis]
        grid = sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(weights))
    return grid


def gaussian(pixels: DataFrame, value: str, sigma: float, truncate: float = 3.0, out: str = "smooth", by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """Blur that skips missing cells: blur(v m) / (blur(m) + 1e-12), NULL where blur(m) < 1e-6.

    Tiles with a halo of the kernel's reach, one for each of ``by``: a cell is copied to its neighbouring tiles only,
    whatever the kernel. Weights falling outside the table are lost, as beyond an image's edge.
    """
    weights = np.array([w for _, w in kernel(sigma, truncate)])
    reach = len(weights) // 2
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("__v")
    near = with_halo(pixels.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), v), tile, reach)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in near.select(*by, "row", "col").schema), f"`{out}` double"])

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        y, x = r - r.min(), c - c.min()
        got = np.full((y.max() + 1, x.max() + 1), np.nan)
        got[y, x] = table.column("__v").to_numpy(zero_copy_only=False)
        known = ~np.isnan(got)
        m = _blurred(known.astype(float), weights)
        smooth = _blurred(np.where(known, got, 0.0), weights) / (m + 1e-12)
        own = np.flatnonzero((r // tile == ty) & (c // tile == tx))
        part = table.take(pa.array(own))
        y, x = y[own], x[own]
        return pa.table([*(part.column(k) for k in (*by, "row", "col")), pa.array(smooth[y, x], pa.float64(), mask=m[y, x] < 1e-6)], names=[*by, "row", "col", out])

    done = near.groupBy(*by, "ty", "tx").applyInArrow(run, schema)
    return pixels.join(done, [*by, "row", "col"], "left")


def local_sigma(pixels: DataFrame, value: str, sigma: float = 2.0, relative: float = 0.02, floor: float = 1e-5, by: Sequence[str] = ()) -> DataFrame:
    """Local noise: sqrt(G((v - G v)^2)) + relative |G v|, floored. Whole-image: tiles have no edges here."""
    g = gaussian(pixels, value, sigma, out="__mu", by=by)
    g = g.withColumn("__d", (F.col(value) - F.col("__mu")) * (F.col(value) - F.col("__mu")))
    g = gaussian(g, "__d", sigma, out="__var", by=by)
    s = F.sqrt(F.greatest("__var", F.lit(0.0))) + relative * F.abs("__mu")
    return g.withColumn("sigma", F.greatest(s, F.lit(floor))).drop("__mu", "__d", "__var")


def lowpass(long: DataFrame, sigma: float, value: str = "value") -> DataFrame:
    """gaussian() of each band; missing cells stay missing."""
    out = gaussian(long, value, sigma, out="__s", by=("wavelength",))
    return out.withColumn(value, F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col("__s"))).drop("__s")


def mosaic(rasters: DataFrame, value: str, how: str = "first", order: str = "source") -> DataFrame:
    """Overlapping rasters to one value a cell: first, min or max."""
    v = {"first": F.min_by(F.col(value), F.col(order)), "min": F.min(value), "max": F.max(value)}[how]
    return rasters.where(F.col(value).isNotNull()).groupBy("row", "col").agg(v.alias(value))


def scatter_last(samples: DataFrame, value: str) -> DataFrame:
    """Swath samples to cells: a later line, then a later sample, overwrites."""
    return samples.groupBy("row", "col").agg(F.max_by(value, F.struct("line", "sample")).alias(value))


def fill_nearby(pixels: DataFrame, value: str, radius: int = 3, out: str = "filled") -> DataFrame:
    """Missing cells take the inverse-distance mean of known cells within ``radius``: an offset join of the gaps only."""
    offsets = [(i, j, 1 / math.hypot(i, j)) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < math.hypot(i, j) <= radius]
    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in offsets])
    known = pixels.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("__v"))
    gaps = pixels.where(F.col(value).isNull()).select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(k).alias("k"))
    near = gaps.select("r0", "c0", (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"), "k.w").join(known, ["row", "col"])
    filled = near.groupBy(F.col("r0").alias("row"), F.col("c0").alias("col")).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("__f"))
    return pixels.join(filled, ["row", "col"], "left").withColumn(out, F.coalesce(value, "__f")).drop("__f")


def fill_distant(pixels: DataFrame, value: str, distance: int = 200, out: str = "filled") -> DataFrame:
    """Missing cells take the inverse-distance mean of the nearest known cell each way along rows, columns and both diagonals.

    Eight directions, cells no farther than ``distance`` steps: each is a running last or first over a line of the
    grid, so the cost does not grow with the distance, and no cell is copied to its surroundings.
    """
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(value).alias("v"), F.col("row").alias("r"), F.col("col").alias("c")))
    df = pixels.withColumn("__k", known).withColumns({"__down": F.col("col") - F.col("row"), "__up": F.col("col") + F.col("row")})
    seen = []
    for n, (line, along) in enumerate((("row", "col"), ("col", "row"), ("__down", "row"), ("__up", "row"))):
        w = Window.partitionBy(line).orderBy(along)
        df = df.withColumns({f"__b{n}": F.last("__k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), f"__f{n}": F.first("__k", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
        seen += [f"__b{n}", f"__f{n}"]
    far = lambda x: F.sqrt((x["r"] - F.col("row")) * (x["r"] - F.col("row")) + (x["c"] - F.col("col")) * (x["c"] - F.col("col")))
    near = F.filter(F.array(*seen), lambda x: x.isNotNull() & (F.greatest(F.abs(x["r"] - F.col("row")), F.abs(x["c"] - F.col("col"))) <= distance))
    df = df.withColumn("__near", F.when(F.col("__k").isNull(), near))
    weight = F.aggregate("__near", F.lit(0.0), lambda a, x: a + 1 / far(x))
    mean = F.try_divide(F.aggregate("__near", F.lit(0.0), lambda a, x: a + x["v"] / far(x)), weight)
    return df.withColumn(out, F.when(F.col("__k").isNull(), mean).otherwise(F.col(value))).select(*pixels.columns, out)


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """``pixels`` copied to every tile (ty, tx) whose cells are within ``halo`` of them."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    return pixels.withColumn("ty", reach("row")).withColumn("tx", reach("col"))


def quadrant_search(grid: np.ndarray, inner: tuple[slice, slice], distance: int) -> np.ndarray:
    """Inverse-distance means of the nearest known cell of each quadrant, for the cells of ``inner``; NaN where none is in reach.

    The quadrants are left (its own column too) and right, upward (its own row too) and downward. Each column's
    nearest known cell above and below is known beforehand; columns are then tried from near to far, all cells at once,
    and of two cells as far the one in the nearer column counts.
    """
    h, w = grid.shape
    known = ~np.isnan(grid)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(known, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(known, rows, 10 * h)[::-1], axis=0)[::-1]
    below = np.vstack([below[1:], np.full((1, w), 10 * h)])
    r, c = np.meshgrid(np.arange(h)[inner[0]], np.arange(w)[inner[1]], indexing="ij")
    total, weight = np.zeros(r.shape), np.zeros(r.shape)
    for near, side in ((above, -1), (below, -1), (above, 1), (below, 1)):
        best, value = np.full(r.shape, np.inf), np.zeros(r.shape)
        for step in range(0 if side < 0 else 1, distance + 1):
            x = c + side * step
            inside = (x >= 0) & (x < w)
            x = np.where(inside, x, 0)
            y = near[r, x]
            d = np.hypot(y - r, step)
            take = inside & (y >= 0) & (y < h) & (d <= distance) & (d < best)
            best = np.where(take, d, best)
            value = np.where(take, grid[np.where(take, y, 0), x], value)
            if not (best > step).any():  # no farther column can be nearer
                break
        hit = np.isfinite(best) & (best > 0)
        total += np.where(hit, value / np.where(hit, best, 1), 0)
        weight += np.where(hit, 1 / np.where(hit, best, 1), 0)
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def fill_quadrants(pixels: DataFrame, value: str, distance: int = 200, tile: int = 512, out: str = "filled") -> DataFrame:
    """Missing cells take the inverse-distance mean of the nearest known cell in each quadrant, none farther than ``distance``.

    Tiles with a halo of that distance, one shuffle of (row, col, value); the other columns are joined back. A cell that
    is not in the table is neither filled nor known. NULL and NaN are missing, and stay NULL where nothing is in reach.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    cells = with_halo(pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), v.alias("v")), tile, distance)

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        r, c = (table.column(n).to_numpy() - t * tile + distance for n, t in (("row", ty), ("col", tx)))
        grid = np.full((tile + 2 * distance,) * 2, np.nan)
        grid[r, c] = table.column("v").to_numpy(zero_copy_only=False)
        own = (r >= distance) & (r < distance + tile) & (c >= distance) & (c < distance + tile) & np.isnan(grid[r, c])
        r, c = r[own], c[own]
        if not len(r):
            found = np.empty(0)
        else:
            box = slice(r.min(), r.max() + 1), slice(c.min(), c.max() + 1)
            found = quadrant_search(grid, box, distance)[r - r.min(), c - c.min()]
        return pa.table({"row": pa.array(r + ty * tile - distance, pa.int32()), "col": pa.array(c + tx * tile - distance, pa.int32()), "__f": pa.array(found, pa.float64(), mask=np.isnan(found))})

    filled = cells.groupBy("ty", "tx").applyInArrow(run, "row int, col int, __f double")
    return pixels.join(filled, ["row", "col"], "left").withColumn(out, F.coalesce(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)), "__f")).drop("__f")


def bounds(pixels: DataFrame, by: str, grow: int = 0) -> DataFrame:
    """The tile of each group's cells (row0, row1, col0, col1), each side moved out by ``grow``."""
    return pixels.groupBy(by).agg((F.min("row") - grow).alias("row0"), (F.max("row") + grow).alias("row1"), (F.min("col") - grow).alias("col0"), (F.max("col") + grow).alias("col1"))


def cover(tiles: DataFrame) -> DataFrame:
    """Bounding tile of all tiles."""
    return tiles.agg(F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.min("col0").alias("col0"), F.max("col1").alias("col1"))


def scattered(grid: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values of valid cells back on the whole grid; NULL elsewhere."""
    return grid.join(values.select("row", "col", *cols), ["row", "col"], "left")


def depths(rasters: DataFrame, target: DataFrame, affine: Sequence[float], how: str = "first", distance: int = 200, resampling: str = "bilinear") -> DataFrame:
    """Depth (positive) at the target's x, y: rasters (row, col, value, source) merged, gaps filled, resampled."""
    merged = mosaic(rasters.withColumn("value", F.abs("value")), "value", how)
    ends = merged.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d"))
    whole = ends.select(F.explode(F.sequence("a", "b")).alias("row"), "c", "d").select("row", F.explode(F.sequence("c", "d")).alias("col"))
    filled = fill_quadrants(whole.join(merged, ["row", "col"], "left"), "value", distance)
    return resample(target, filled.select("row", "col", F.col("filled").alias("value")), "value", affine, resampling)


def resample(target: DataFrame, source: DataFrame, value: str, affine: Sequence[float], how: str = "bilinear") -> DataFrame:
    """Source raster at the target's x, y: nearest, bilinear or cubic; NULL beside a missing cell. Equi-joins, no range join.

    For a target in another projection, its x and y are first made by geo.tm_inverse and geo.tm_forward.
    """
    a, _, c, _, e, f = affine
    if how == "cubic":
        return _cubic(target, source, value, affine)
    u, v = (F.col("x") - c) / a - 0.5, (F.col("y") - f) / e - 0.5
    if how == "nearest":
        t = target.withColumns({"__r": F.round(v, 0).cast("int"), "__c": F.round(u, 0).cast("int")})
        return t.join(source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value), ["__r", "__c"], "left").drop("__r", "__c")
    t = target.withColumns({"__u": u, "__v": v})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = t.withColumn("k", F.explode(corners)).withColumns({
        "__r": (F.floor("__v") + F.col("k.i")).cast("int"), "__c": (F.floor("__u") + F.col("k.j")).cast("int"),
        "__w": (1 - F.abs(F.col("__v") - F.floor("__v") - F.col("k.i"))) * (1 - F.abs(F.col("__u") - F.floor("__u") - F.col("k.j"))),
    }).where("__w > 0")
    s = source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    out = four.join(s, ["__r", "__c"], "left").groupBy(*target.columns).agg(F.sum(F.col("__w") * F.col(value)).alias(value), F.sum(F.when(F.col(value).isNotNull(), F.col("__w"))).alias("__m"))
    return out.withColumn(value, F.when(F.col("__m") > 1 - 1e-9, F.col(value))).drop("__m")


def cubic_weights(t: np.ndarray) -> np.ndarray:
    """Weights of the four cells at -1, 0, 1 and 2 for a place ``t`` between the middle two (cubic convolution, a = -1/2)."""
    return np.stack([((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t])


def _cubic(target: DataFrame, source: DataFrame, value: str, affine: Sequence[float], tile: int = 256, most: int = 100_000) -> DataFrame:
    """Sixteen cells a target, gathered in tiles: targets are dealt by the cell they lie in, sources come with a halo of two.

    A tile of more than ``most`` targets is dealt in parts of about so many, each with the tile's cells, so that what a
    task holds follows neither the number of targets nor where they lie.
    """
    a, _, c, _, e, f = map(float, affine)
    u, v = (F.col("x") - c) / a - 0.5, (F.col("y") - f) / e - 0.5
    t = target.withColumns({"__u": u, "__v": v, "ty": F.floor(F.floor(v) / tile).cast("int"), "tx": F.floor(F.floor(u) / tile).cast("int")})
    cells = with_halo(source.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("__s")), tile, 2)
    full = materialize(t.groupBy("ty", "tx").agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).where("__parts > 1 and ty is not null and tx is not null"), "crowded")  # a row for ``most`` targets at most
    small = full.count() <= 100_000
    t = t.join(F.broadcast(full) if small else full, ["ty", "tx"], "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*target.columns), "__parts"), F.lit(0)).cast("int")).drop("__parts")
    cells = cells.join(F.broadcast(full) if small else full, ["ty", "tx"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in target.schema if x.name != value), f"`{value}` double"])
    keep = [x.name for x in target.schema if x.name != value]

    def run(points: pa.Table, known: pa.Table) -> pa.Table:
        if not len(points):
            return pa.table([points.column(k) for k in keep] + [pa.array([], pa.float64())], names=[*keep, value])
        ty, tx = points.column("ty")[0].as_py(), points.column("tx")[0].as_py()
        grid = np.full((tile + 4, tile + 4), np.nan)
        if len(known):
            grid[known.column("row").to_numpy() - ty * tile + 2, known.column("col").to_numpy() - tx * tile + 2] = known.column("__s").to_numpy(zero_copy_only=False)
        y, x = points.column("__v").to_numpy(zero_copy_only=False), points.column("__u").to_numpy(zero_copy_only=False)
        ok = np.isfinite(x) & np.isfinite(y)
        y, x = np.where(ok, y, ty * tile), np.where(ok, x, tx * tile)
        r, k = np.floor(y).astype(int), np.floor(x).astype(int)
        wy, wx = cubic_weights(y - r), cubic_weights(x - k)
        got = np.zeros(len(r))
        for i in range(4):
            for j in range(4):
                got += wy[i] * wx[j] * grid[r - ty * tile + 1 + i, k - tx * tile + 1 + j]  # one missing cell makes it missing
        bad = np.isnan(got) | ~ok
        return pa.table([points.column(n) for n in keep] + [pa.array(got, pa.float64(), mask=bad)], names=[*keep, value])

    there = t.where("ty is not null and tx is not null")
    out = there.groupBy("ty", "tx", "__part").cogroup(cells.groupBy("ty", "tx", "__part")).applyInArrow(run, schema)
    return out.unionByName(t.where("ty is null or tx is null").select(*keep, F.lit(None).cast("double").alias(value)))


def geotransform(pixels: DataFrame) -> DataFrame:
    """Origin, spacing and y direction of a regular grid from its coordinates (distinct axes only)."""
    out = None
    for axis in ("x", "y"):
        d = pixels.select(axis).distinct()
        step = d.select((F.lead(axis).over(Window.partitionBy(F.lit(0)).orderBy(axis)) - F.col(axis)).alias("s")).agg(F.median("s").alias(f"d{axis}"))
        ends = d.agg(F.min(axis).alias(f"{axis}_min"), F.max(axis).alias(f"{axis}_max"))
        one = step.crossJoin(ends)  # one row each
        out = one if out is None else out.crossJoin(one)
    down = pixels.agg((F.min_by("y", "row") >= F.max_by("y", "row")).alias("y_down"))
    return out.crossJoin(down)

"""Image segmentation by tile: graph-based (Felzenszwalb & Huttenlocher 2004) and SLIC (Achanta et al. 2012).

Both need a neighbourhood at once, so they run as grouped maps over tiles of a
bounded number of pixels; labels are made unique by the tile's number. A scene
of any size is many tiles, never one task. Graph segments that meet across tile
edges are joined (``seams``) where the graph's own rule joins them: the seam's least
edge is no more than both sides' internal difference plus scale over size. SLIC tiles carry the
surroundings that their labels depend on, so its segments are the same however a scene is cut;
like neighbours are joined by segment.merge_by_distance().
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .raster import with_halo
from .segment import connected
from .spectral import covariance


def _grid(pdf: pd.DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)
    r, c = r - r.min(), c - c.min()
    x = np.full((r.max() + 1, c.max() + 1, len(features)), np.nan)
    x[r, c] = pdf[list(features)].to_numpy(float)
    return x, np.isfinite(x).all(axis=2), r, c


def graph_labels(x: np.ndarray, ok: np.ndarray, scale: float, min_size: int) -> np.ndarray:
    return graph_segments(x, ok, scale, min_size)[0]


def graph_segments(x: np.ndarray, ok: np.ndarray, scale: float, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and the internal difference of each cell's segment. Merge along edges of rising weight while it is below both sides' internal difference + scale / size; 0 is masked."""
    h, w = ok.shape
    ids = np.arange(h * w).reshape(h, w)
    edges = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = ok[a] & ok[b]
        d = np.sqrt(((x[a] - x[b]) ** 2).sum(axis=2))[both]
        edges.append(np.column_stack([d, ids[a][both], ids[b][both]]))
    e = np.vstack(edges)
    e = e[np.argsort(e[:, 0], kind="stable")]
    root, size, inner = np.arange(h * w), np.ones(h * w, int), np.zeros(h * w)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for d, p, q in e:
        p, q = find(int(p)), find(int(q))
        if p != q and d <= min(inner[p] + scale / size[p], inner[q] + scale / size[q]):
            root[q] = p
            size[p] += size[q]
            inner[p] = d
    for d, p, q in e:
        p, q = find(int(p)), find(int(q))
        if p != q and min(size[p], size[q]) < min_size:
            root[q] = p
            size[p] += size[q]
    out = np.array([find(k) for k in range(h * w)]).reshape(h, w)
    _, dense = np.unique(out[ok], return_inverse=True)
    labels = np.zeros((h, w), int)
    labels[ok] = dense + 1
    return labels, inner[out]


def components(same: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Of ``n`` cells the least cell each is joined to by pairs: hooking on the lesser root and pointer jumping, all pairs at once."""
    root = np.arange(n)
    a, b = (np.concatenate([p[k] for p in same]) for k in (0, 1))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _pairs(h: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells side by side and one below the other."""
    ids = np.arange(h * w).reshape(h, w)
    return [(ids[:, :-1].ravel(), ids[:, 1:].ravel()), (ids[:-1].ravel(), ids[1:].ravel())]


def slic_clusters(x: np.ndarray, ok: np.ndarray, row0: int, col0: int, step: float, compactness: float, rounds: int) -> np.ndarray:
    """Number of the nearest centre in features and place of each cell, -1 without one: local k-means (Achanta et al. 2012).

    Centres begin at a grid of ``step`` over the whole scene, each at the valid cell nearest to its place; a centre is
    compared with the cells within ``step`` of it only, and the number of rounds is fixed, so that what a cell gets
    depends on its surroundings and not on where a tile was cut.
    """
    h, w = ok.shape
    rows, cols = np.arange(row0, row0 + h, dtype=float), np.arange(col0, col0 + w, dtype=float)
    centres = []
    for gy in range(int(np.floor(row0 / step)), int(np.ceil((row0 + h) / step))):
        for gx in range(int(np.floor(col0 / step)), int(np.ceil((col0 + w) / step))):
            cy, cx = (gy + 0.5) * step, (gx + 0.5) * step
            r = slice(max(int(np.ceil(cy - step / 2)) - row0, 0), max(int(np.ceil(cy + step / 2)) - row0, 0))
            c = slice(max(int(np.ceil(cx - step / 2)) - col0, 0), max(int(np.ceil(cx + step / 2)) - col0, 0))
            part = ok[r, c]
            if not part.any():
                continue
            d = np.where(part, (rows[r][:, None] - cy) ** 2 + (cols[c] - cx) ** 2, np.inf)
            i, j = np.unravel_index(d.argmin(), d.shape)
            i, j = i + r.start, j + c.start
            centres.append((rows[i], cols[j], *x[i, j]))
    label = np.full((h, w), -1)
    if not centres:
        return label
    centre = np.array(centres)
    pull = (compactness / step) ** 2
    flat = np.concatenate([np.repeat(rows, w)[:, None], np.tile(cols, h)[:, None], x.reshape(h * w, -1)], axis=1)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        label = np.full((h, w), -1)
        for k, (cy, cx, *f) in enumerate(centre):
            r = slice(max(int(np.ceil(cy - step)) - row0, 0), max(int(np.floor(cy + step)) + 1 - row0, 0))
            c = slice(max(int(np.ceil(cx - step)) - col0, 0), max(int(np.floor(cx + step)) + 1 - col0, 0))
            d = ((x[r, c] - f) ** 2).sum(axis=2) + pull * ((rows[r][:, None] - cy) ** 2 + (cols[c] - cx) ** 2)
            near = d < best[r, c]  # never where a feature is missing
            best[r, c][near] = d[near]
            label[r, c][near] = k
        own = label.ravel() >= 0
        lab = label.ravel()[own]
        n = np.bincount(lab, minlength=len(centre))
        for k in range(centre.shape[1]):
            total = np.bincount(lab, flat[own, k], minlength=len(centre))
            centre[:, k] = np.where(n > 0, total / np.maximum(n, 1), centre[:, k])
    return np.where(ok, label, -1)


def connected_labels(label: np.ndarray, ok: np.ndarray, min_size: int, passes: int = 3) -> np.ndarray:
    """Least cell of each valid cell's segment, -1 elsewhere: connected parts of the labels, those under ``min_size`` cells joined
    to the larger one they share the longest border with (of equals, the one whose first cell comes first)."""
    h, w = ok.shape
    flat, valid = label.ravel(), ok.ravel()
    pairs = [(a[valid[a] & valid[b]], b[valid[a] & valid[b]]) for a, b in _pairs(h, w)]
    root = components([(a[flat[a] == flat[b]], b[flat[a] == flat[b]]) for a, b in pairs], h * w)
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    for _ in range(passes):
        size = np.bincount(root[valid], minlength=h * w)
        x, y = root[a], root[b]
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        small = (x != y) & (size[x] < min_size) & (size[y] >= min_size)
        if not small.any():
            break
        borders, length = np.unique(np.column_stack([x[small], y[small]]), axis=0, return_counts=True)
        order = np.lexsort([borders[:, 1], -length, borders[:, 0]])
        first = np.append(True, borders[order][1:, 0] != borders[order][:-1, 0])
        to = np.arange(h * w)
        to[borders[order][first, 0]] = borders[order][first, 1]
        root = to[root]
    return np.where(valid, root, -1).reshape(h, w)


def slic_reach(step: float, rounds: int) -> int:
    """Cells round a tile on which its labels may depend: two steps a round, then the parts of a cluster and what joins them."""
    return int(np.ceil((2 * rounds + 8) * step))


def slic(pixels: DataFrame, features: Sequence[str], tile: int = 256, area: float = 50, compactness: float = 0.1, rounds: int = 10, min_size: int | None = None) -> DataFrame:
    """row, col, seg_id (0 masked) of connected segments of about ``area`` cells, the same for any ``tile``.

    Tiles are worked on with all the cells their labels depend on; a segment's id is its first cell's place in the
    scene, so that its parts in several tiles have it in common. Cells with a missing feature are masked.
    """
    step = float(np.sqrt(area))
    halo = slic_reach(step, rounds)
    least = max(1, int(area / 4)) if min_size is None else min_size
    near = with_halo(pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *features), tile, halo)

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        own = (row // tile == ty) & (col // tile == tx)
        if not own.any():
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "seg_id": pa.array([], pa.int64())})
        row0, col0 = int(row.min()), int(col.min())
        x = np.full((row.max() - row0 + 1, col.max() - col0 + 1, len(features)), np.nan)
        for k, f in enumerate(features):
            x[row - row0, col - col0, k] = table.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False)
        ok = np.isfinite(x).all(axis=2)
        first = connected_labels(slic_clusters(x, ok, row0, col0, step, compactness, rounds), ok, least)
        first = first[row[own] - row0, col[own] - col0]
        y, z = first // ok.shape[1] + row0, first % ok.shape[1] + col0
        return pa.table({"row": row[own], "col": col[own], "seg_id": np.where(first < 0, 0, y.astype(np.int64) * (1 << 31) + z + 1)})

    return near.groupBy("ty", "tx").applyInArrow(run, "row int, col int, seg_id long")


def n_segments(pixels: int, area: int, low: int = 1, high: int = 10_000) -> int:
    return int(min(max(-(-pixels // area), low), high))


def segments_wanted(pixels: Column, area: int, low: int = 1, high: int = 10_000) -> Column:
    return F.least(F.greatest(F.ceil(pixels / area), F.lit(low)), F.lit(high)).cast("int")


def segment(pixels: DataFrame, features: Sequence[str], how: str = "graph", tile: int = 256, seams: bool = False, **options) -> DataFrame:
    """row, col, seg_id (0 masked), one grouped map a tile; with ``seams`` graph segments are joined over the edges of tiles."""
    if how == "slic":
        return slic(pixels, features, tile, **options)
    tiled = pixels.select("row", "col", *features).withColumns({"ty": F.floor(F.col("row") / tile).cast("int"), "tx": F.floor(F.col("col") / tile).cast("int")})
    scale = options.get("scale", 400.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ok, r, c = _grid(pdf, features)
        labels, inner = graph_segments(x, ok, scale, options.get("min_size", 50))
        lab = labels[r, c].astype(np.int64)
        base = (int(pdf["ty"].iloc[0]) * (1 << 20) + int(pdf["tx"].iloc[0])) * (tile * tile + 1)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "seg_id": np.where(lab > 0, base + lab, 0), "inner": inner[r, c]})

    got = tiled.groupBy("ty", "tx").applyInPandas(run, "row int, col int, seg_id long, inner double")
    if not seams:
        return got.drop("inner")
    got = materialize(got, "tiles")
    if got.agg(F.greatest(F.max("row"), F.max("col"))).first()[0] in (None, *range(tile)):
        return got.drop("inner")  # one tile
    return _joined_seams(got, pixels, features, tile, scale)


def _joined_seams(got: DataFrame, pixels: DataFrame, features: Sequence[str], tile: int, scale: float) -> DataFrame:
    """Segments on both sides of a seam as one where the least edge across it allows."""
    parts = got.where("seg_id <> 0").groupBy("seg_id").agg(F.count("*").alias("size"), F.max("inner").alias("inner"))
    slack = parts.select(F.col("seg_id").alias("s"), (F.col("inner") + scale / F.col("size")).alias("slack"))
    edge = [F.col(c) % tile == k for c in ("row", "col") for k in (0, tile - 1)]
    rim = got.where("seg_id <> 0").where(edge[0] | edge[1] | edge[2] | edge[3]).join(pixels.select("row", "col", *features), ["row", "col"]).select("row", "col", F.col("seg_id").alias("a"), *features)
    seams = []
    for axis, other in (("row", "col"), ("col", "row")):
        low = rim.where(F.col(axis) % tile == tile - 1).withColumn(axis, F.col(axis) + 1)
        high = rim.where(F.col(axis) % tile == 0).select(axis, other, F.col("a").alias("b"), *[F.col(f).alias(f"{f}_b") for f in features])
        d2 = sum(((F.col(f) - F.col(f"{f}_b")) * (F.col(f) - F.col(f"{f}_b")) for f in features), F.lit(0.0))
        seams.append(low.join(high, [axis, other]).select("a", "b", F.sqrt(d2).alias("d")))
    least = seams[0].unionByName(seams[1]).groupBy("a", "b").agg(F.min("d").alias("d"))
    left, right = slack.select(F.col("s").alias("a"), F.col("slack").alias("sa")), slack.select(F.col("s").alias("b"), F.col("slack").alias("sb"))
    close = least.join(left, "a").join(right, "b").where(F.col("d") <= F.least("sa", "sb")).select("a", "b")
    roots = connected(close, slack, "s").select(F.col("node").alias("seg_id"), "root")
    return got.join(roots, "seg_id", "left").select("row", "col", F.coalesce("root", "seg_id").alias("seg_id"))


def pca_features(pixels: DataFrame, spectrum: str, key: Sequence[str], k: int = 6) -> DataFrame:
    """log1p, robust scaling by the 10th and 90th percentile, and ``k`` principal components (signs are arbitrary)."""
    from pyspark.ml.feature import PCA, RobustScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = pixels.select(*key, array_to_vector(F.transform(spectrum, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))).alias("v"))
    scaled = RobustScaler(inputCol="v", outputCol="s", lower=0.1, upper=0.9, withCentering=True).fit(v).transform(v)
    return PCA(k=k, inputCol="s", outputCol="p").fit(scaled).transform(scaled).select(*key, vector_to_array("p").alias("pcs"))


def normalised_features(pixels: DataFrame, spectrum: str, key: Sequence[str]) -> DataFrame:
    """Spectra of sum one and the log of their sum."""
    total = F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x)
    return pixels.select(*key, F.transform(spectrum, lambda x: F.try_divide(x, total)).alias("shape"), F.log1p(F.greatest(total, F.lit(0.0))).alias("magnitude"))


def moment_pca(df: DataFrame, vector: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components, variances) of the ``k`` first principal components of all rows, signs so that each component's largest entry is positive.

    Moments are summed task by task over all rows; only their matrix (size * size numbers) comes to the driver.
    """
    mean = df.agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(size)]).first()
    matrix = np.zeros((size, size))
    for r in covariance(df, vector, size).collect():  # size * (size + 1) / 2 rows
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["cov"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return np.array([m or 0.0 for m in mean]), vectors, np.maximum(values[order], 0.0)


def magnitude_features(pixels: DataFrame, spectrum: str, size: int, key: Sequence[str], k: int = 6, scaled: bool = True) -> DataFrame:
    """``key`` and ``features``: ``k`` principal components of the spectra's shapes and, last, the log of their sums.

    With ``scaled`` each has mean zero and deviation one over all pixels, as distances in segmentation want it; a
    constant one is zero. NULL where a spectrum has no shape.
    """
    n = normalised_features(pixels, spectrum, key)
    ok = F.forall("shape", lambda v: v.isNotNull() & ~F.isnan(v))
    n = n.withColumn("shape", F.when(ok, F.col("shape")))
    mean, vectors, values = moment_pca(n.where("shape is not null"), "shape", size, k)
    centre, dev = n.where("shape is not null").agg(F.avg("magnitude"), F.stddev_pop("magnitude")).first()
    part = lambda j: F.aggregate(F.zip_with("shape", F.array(*[F.lit(float(x)) for x in vectors[:, j]]), lambda a, b: a * b), F.lit(-float(mean @ vectors[:, j])), lambda a, x: a + x)
    unit = lambda x, d: x / F.lit(float(d)) if d and d > 1e-12 else F.lit(0.0)
    parts = [unit(part(j), values[j] ** 0.5) if scaled else part(j) for j in range(len(values))]
    last = unit(F.col("magnitude") - F.lit(centre or 0.0), dev) if scaled else F.col("magnitude")
    return n.select(*key, F.when(F.col("shape").isNotNull(), F.array(*parts, last)).alias("features"))

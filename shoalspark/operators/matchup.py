"""In-situ points against scenes: time filter, nearest cell, pixel windows, footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def within_hours(a: Column, b: Column, hours: float) -> Column:
    """Strictly less than ``hours`` apart."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) < hours * 3.6e9


def dedupe(points: DataFrame, cols: Sequence[str]) -> DataFrame:
    return points.select(*cols).dropDuplicates(list(cols))


def windows(points: DataFrame, x: str, y: str, affine: geo.Affine, n_rows: int, n_cols: int, size: int = 7, clamp: bool = True) -> DataFrame:
    """Each point's nearest cell on a regular grid and the window round it.

    Points off the grid go to its edge, as nearest-neighbour selection has it;
    with ``clamp`` both window ends stay on the grid, else only the start does.
    """
    a, _, c, _, e, f = affine
    half = size // 2
    out = points.withColumn("col", geo.nearest_index(F.col(x), c + a / 2, a, n_cols)).withColumn("row", geo.nearest_index(F.col(y), f + e / 2, e, n_rows))
    for k, n in (("row", n_rows), ("col", n_cols)):
        out = out.withColumn(f"{k}0", F.greatest(F.col(k) - half, F.lit(0)))
        out = out.withColumn(f"{k}1", F.least(F.col(k) + half, F.lit(n - 1)) if clamp else F.col(k) + half)
    return out


def last_per_uuid(points: DataFrame, order: str) -> DataFrame:
    """Repeated ids: the last wins."""
    return points.groupBy("uuid").agg(*[F.max_by(c, order).alias(c) for c in points.columns if c not in ("uuid", order)], F.max(order).alias(order))


def window_join(pixels: DataFrame, points: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels inside each point's window: an equi-join on tiles that narrows a range join.

    A window is copied to the tiles it touches; a pixel has one tile. Both sides
    shuffle by tile, and no pair outside a shared tile is ever formed.
    """
    p = points.withColumn("tile_y", F.explode(F.sequence(F.floor(F.col("row0") / tile), F.floor(F.col("row1") / tile))))
    p = p.withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("col0") / tile), F.floor(F.col("col1") / tile))))
    p = p.withColumnsRenamed({"row": "center_row", "col": "center_col"}).withColumnsRenamed({c: f"p_{c}" for c in set(points.columns) & set(pixels.columns) - {"row", "col"}})
    q = pixels.withColumn("tile_y", F.floor(F.col("row") / tile)).withColumn("tile_x", F.floor(F.col("col") / tile))
    inside = F.col("row").between(F.col("row0"), F.col("row1")) & F.col("col").between(F.col("col0"), F.col("col1"))
    return q.join(p, ["tile_y", "tile_x"]).where(inside).drop("tile_y", "tile_x")


def in_footprint(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points whose nearest cell is valid: a semi join instead of a polygon."""
    cells = pixels.where("valid").select("row", "col")
    return points.join(cells, ["row", "col"], "left_semi")


def footprint_box(pixels: DataFrame) -> DataFrame:
    v = pixels.where("valid")
    return v.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n_valid"))


def window_boxes(points: DataFrame, affine: geo.Affine) -> DataFrame:
    """Projected outer bounds of each window."""
    x0, y0 = geo.grid_xy(F.col("col0"), F.col("row0"), affine, "ul")
    x1, y1 = geo.grid_xy(F.col("col1"), F.col("row1"), affine, "lr")
    return points.withColumns({"x_min": F.least(x0, x1), "x_max": F.greatest(x0, x1), "y_min": F.least(y0, y1), "y_max": F.greatest(y0, y1)})


def window_means(long: DataFrame, by: Sequence[str] = ("uuid", "wavelength"), value: str = "value") -> DataFrame:
    return long.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


#: What a point's window is told by.
WINDOW = ("row0", "row1", "col0", "col1")


def different_windows(pixels: DataFrame, points: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels inside each different window of the points, once however many points share it, dealt by window: groups of windows need no further shuffle."""
    return by_window(window_join(pixels, points.select(*WINDOW).distinct(), tile))


def by_window(df: DataFrame) -> DataFrame:
    """Dealt by window into a fixed number of tasks: what is small here is many rows once its bands are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *WINDOW)


def repeated_ids(points: DataFrame) -> DataFrame | None:
    """Ids of more than one point; None without any."""
    again = points.groupBy("uuid").count().where("count > 1").select("uuid")
    return None if again.isEmpty() else again


def window_spectra(pixels: DataFrame, spectrum: str, points: DataFrame, tile: int = 64) -> DataFrame:
    """(uuid, wl_idx, mean, n): mean spectra of the points' windows.

    A scene has no more windows than cells, so each different one is averaged once, and points take its bands by an
    equi-join; no pixel is copied to its points. Points that share an id are averaged over the pixels of all of them.
    """

    def bands(near: DataFrame, by: Sequence[str]) -> DataFrame:
        return window_means(near.select(*by, F.posexplode(spectrum).alias("wl_idx", "value")), (*by, "wl_idx"))

    again = repeated_ids(points)
    once = points if again is None else points.join(again, "uuid", "left_anti")
    p = pixels.select("row", "col", spectrum)
    packed = bands(different_windows(p, once, tile), WINDOW).groupBy(*WINDOW).agg(F.collect_list(F.struct("wl_idx", "mean", "n")).alias("b"))  # a sensor's bands
    out = by_window(once.select("uuid", *WINDOW)).join(packed, list(WINDOW)).select("uuid", F.inline("b"))
    if again is None:
        return out
    return out.unionByName(bands(window_join(p, points.join(again, "uuid", "left_semi"), tile), ("uuid",)))


def pixel_line(pixels: DataFrame, line: int, window: int) -> DataFrame:
    """Pixels of ``line`` .. ``line + window``, both ends included."""
    return pixels.where(F.col("line_index").between(line, line + window))


def crop(pixels: DataFrame, box: Sequence[float], x: str = "x", y: str = "y") -> DataFrame:
    """x0, y0, x1, y1 in either order; a plain range predicate that reaches the scan."""
    x0, y0, x1, y1 = box
    return pixels.where(F.col(x).between(min(x0, x1), max(x0, x1)) & F.col(y).between(min(y0, y1), max(y0, y1)))


def crop_lonlat(pixels: DataFrame, box: Sequence[float], central_meridian: float, x: str = "x", y: str = "y", steps: int = 21, margin: float = 0.0) -> DataFrame:
    """Pixels of a transverse Mercator grid inside the projected bounds of a box (lon0, lat0, lon1, lat1), widened by ``margin``.

    The box's sides are projected at ``steps`` places each, since they are no straight lines on the grid; the bounds are
    one row, and what is left is a range predicate that reaches the scan.
    """
    lon0, lat0, lon1, lat1 = box
    t = F.col("id") % steps / (steps - 1)
    side = F.floor(F.col("id") / steps)
    lon = F.when(side == 0, lon0 + (lon1 - lon0) * t).when(side == 1, lon0 + (lon1 - lon0) * t).when(side == 2, F.lit(float(lon0))).otherwise(F.lit(float(lon1)))
    lat = F.when(side == 0, F.lit(float(lat0))).when(side == 1, F.lit(float(lat1))).otherwise(lat0 + (lat1 - lat0) * t)
    px, py = geo.tm_forward(F.col("lat"), F.col("lon"), central_meridian)
    rim = pixels.sparkSession.range(4 * steps).select(lat.alias("lat"), lon.alias("lon")).select(px.alias("px"), py.alias("py"))
    a = rim.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py")).first()
    return crop(pixels, (a[0] - margin, a[1] - margin, a[2] + margin, a[3] + margin), x, y)


def bracket(points: DataFrame, ts: str, series: DataFrame, series_ts: str, values: Sequence[str]) -> DataFrame:
    """Hourly series at each point's time, linear between the hours before and after; NULL where one is missing.

    Two equi-joins on the hour, so the series is read by key and never scanned by range.
    """
    low, high, w = geo.bracket_hours(F.col(ts))
    p = points.withColumns({"__low": low, "__high": high, "__w": w})
    s = series.select(F.date_trunc("hour", series_ts).alias("__h"), *values)
    a = s.select(F.col("__h").alias("__low"), *[F.col(v).alias(f"__{v}0") for v in values])
    b = s.select(F.col("__h").alias("__high"), *[F.col(v).alias(f"__{v}1") for v in values])
    out = p.join(a, "__low", "left").join(b, "__high", "left")
    at = lambda v: F.when(F.col("__w") == 0, F.col(f"__{v}0")).otherwise(F.col(f"__{v}0") * (1 - F.col("__w")) + F.col(f"__{v}1") * F.col("__w"))
    return out.select(*points.columns, *[at(v).alias(v) for v in values])


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they first appear."""
    return df.groupBy(key).agg(F.min(order).alias("first")).orderBy("first", key)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def some(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no points are left: {what}")
    return df


def extract_pixels(pixels: DataFrame, points: DataFrame, affine: geo.Affine, n_rows: int, n_cols: int, size: int = 1, hours: float | None = None, scene_time: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels round in-situ points, and the points' windows.

    Points (uuid, x, y, date_time) are kept if near in time, once each, if they
    lie in a valid cell; nothing left is an error at each step. Of repeated ids
    the last wins. The windows' upper ends are not held to the grid.
    """
    if hours is not None:
        points = some(points.where(within_hours(F.col("date_time"), scene_time, hours)), f"none within {hours} hours")
    points = points.dropDuplicates(["uuid", "x", "y"])
    placed = windows(points, "x", "y", affine, n_rows, n_cols, size, clamp=False)
    inside = some(in_footprint(placed, pixels), "none in the footprint")
    last = last_per_uuid(inside, "date_time")
    return window_join(pixels, last), last


def crop_to_table(pixels: DataFrame, box: Sequence[float], spectrum: str, wavelengths: Sequence[float], limits: Sequence[float]) -> DataFrame:
    """A box and a range of wavelengths of a scene, written to the shared folder; no overlap is an error."""
    from ..storage import materialize
    from .spectral import mask_wavelength, take_bands

    part = take_bands(spectrum, mask_wavelength(wavelengths, limits))
    return some(materialize(crop(pixels, box).withColumn(spectrum, part), "crop"), "the box does not meet the scene")


def value_at(points: DataFrame, uuid, wavelength: str = "wavelength") -> DataFrame:
    """One point's spectrum in wavelength order."""
    return points.where(F.col("uuid") == uuid).orderBy(wavelength)

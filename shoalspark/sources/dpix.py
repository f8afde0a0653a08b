"""Airborne scenes as folders: a raw cube (.pix) with its text header, the swath's ground positions (.glu) and a navigation log.

``open_scene`` reads the headers and gives the scene's pixels and swath as tables; ``with_geometry`` puts the swath's view
angles on the grid and adds the sun's. Cubes are read by block of lines, and of a block only the bands and lines that are
asked for; a window of the scene is a window of every read.

Cubes are plain rasters, in any of the three interleaves, or database files of 512-byte blocks that name their own layout
("PCIDSK" in front): there band or pixel interleave, without compression. Files are opened at an offset in the tasks,
through Arrow's file systems (a plain path is a folder that all executors mount).

Empty windows give no rows; a window that does not meet the scene is an error, as is a header without its size. Counts of
zero and the no-data count are NULL in ``radiance``; ``valid`` tells whether the first band differs from the no-data count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geo
from ..operators import raster
from . import envi, scene

#: Numpy types of the header's data type codes.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}


@dataclass(frozen=True)
class Layout:
    samples: int
    lines: int
    bands: int
    dtype: str
    interleave: str = "bsq"
    offset: int = 0
    line_bytes: int = 0  # of a line of all bands, in pixel interleave; more than its cells where lines are padded


def layout(header: dict) -> Layout:
    order = ">" if header.get("byte order", "0").strip() == "1" else "<"
    kind = TYPES[int(header["data type"])]
    return Layout(int(header["samples"]), int(header["lines"]), int(header["bands"]), order + kind, header.get("interleave", "bsq").strip().lower(), int(header.get("header offset", 0)))


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def own_layout(first: bytes, image_header: bytes, given: Layout) -> Layout:
    """The layout that a database file names in its first blocks; all of its channels are of the header's type."""
    number = lambda at, n: int(first[at : at + n].decode("ascii").strip() or 0)
    how = first[360:368].decode("ascii").strip().upper()
    if how not in ("BAND", "PIXEL"):
        raise ValueError(f"channels by {how or 'nothing'} cannot be read")
    samples, lines, size = number(384, 8), number(392, 8), np.dtype(given.dtype).itemsize
    order = "<" if image_header[201:202] == b"S" else ">"
    padded = -(-given.bands * samples * size // 512) * 512
    return replace(given, samples=samples, lines=lines, dtype=order + given.dtype[1:], interleave="bsq" if how == "BAND" else "bip", offset=(number(304, 16) - 1) * 512, line_bytes=padded if how == "PIXEL" else 0)


def resolved(path: str, given: Layout) -> Layout:
    with _open(path) as f:
        first = f.read(512)
        if not first.startswith(b"PCIDSK"):
            return given
        f.seek((int(first[336:352]) - 1) * 512)
        return own_layout(first, f.read(1024), given)


def block_of(f, la: Layout, bands: Sequence[int], first: int, last: int, col0: int, col1: int) -> np.ndarray:
    """Values (lines, columns, bands) of lines first .. last - 1; by band, only the bands asked for are read."""
    t = np.dtype(la.dtype)
    n = last - first

    def take(at: int, count: int) -> np.ndarray:
        f.seek(la.offset + at)
        raw = f.read(count)
        if len(raw) < count:
            raise ValueError("the cube is shorter than its header says")
        return np.frombuffer(raw, np.uint8)

    if la.interleave == "bsq":
        plane = la.samples * t.itemsize
        parts = [take((b * la.lines + first) * plane, n * plane).view(t).reshape(n, la.samples)[:, col0:col1] for b in bands]
        return np.stack(parts, axis=2)
    line = la.line_bytes or la.samples * la.bands * t.itemsize
    raw = take(first * line, n * line).reshape(n, line)[:, : la.samples * la.bands * t.itemsize]
    whole = np.ascontiguousarray(raw).view(t)
    if la.interleave == "bil":
        return whole.reshape(n, la.bands, la.samples)[:, list(bands), col0:col1].transpose(0, 2, 1)
    return whole.reshape(n, la.samples, la.bands)[:, col0:col1][:, :, list(bands)]


class RasterBlocks(DataSource):
    """``spark.read.format("raster_blocks")``: rows (row, col, first, counts) of a window of a raw cube.

    Options: path, layout (JSON of a ``Layout``), bands (JSON list), window (JSON: row0, row1, col0, col1; ends excluded),
    block (lines a partition). ``first`` is the first band's count, whatever bands are asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return "row int, col int, first double, counts array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    BATCH = 1 << 20  # values of a record batch

    def __init__(self, options):
        self.path, self.layout = options["path"], Layout(**json.loads(options["layout"]))
        self.bands, self.window = json.loads(options["bands"]), json.loads(options["window"])
        self.block = int(options.get("block", 256))

    def partitions(self) -> list[InputPartition]:
        self.layout = resolved(self.path, self.layout)
        r0, r1 = self.window[:2]
        return [InputPartition((a, min(a + self.block, r1))) for a in range(r0, r1, self.block)] or [InputPartition((r0, r0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        la = resolved(self.path, self.layout)
        a, b = partition.value
        c0, c1 = self.window[2:]
        wanted = [0, *self.bands]
        step = max(1, self.BATCH // (la.samples * max(len(wanted), 1 if la.interleave == "bsq" else la.bands)))
        with _open(self.path) as f:
            for r in range(a, b, step):
                got = block_of(f, la, wanted, r, min(r + step, b), c0, c1).astype(np.float64)
                n, width, _ = got.shape
                ends = pa.array(np.arange(n * width + 1) * len(self.bands), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(r, r + n), width), pa.int32()), pa.array(np.tile(np.arange(c0, c1), n), pa.int32()),
                    pa.array(got[:, :, 0].ravel()), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(got[:, :, 1:]).ravel())),
                ], names=["row", "col", "first", "counts"])


def blocks(spark: SparkSession, path: str, la: Layout, bands: Sequence[int], window: Sequence[int], block: int = 256) -> DataFrame:
    spark.dataSource.register(RasterBlocks)
    return spark.read.format("raster_blocks").options(path=path, layout=json.dumps(vars(la)), bands=json.dumps(list(bands)), window=json.dumps([int(x) for x in window]), block=block).load()


@dataclass(frozen=True)
class Scene:
    name: str
    header: dict
    affine: tuple
    projection: str
    wavelengths: list[float]
    fwhm: list[float] | None
    good: list[bool]
    acquired: str | None  # UTC
    window: tuple[int, int, int, int]
    pixels: DataFrame  # row, col, x, y (of the cells' upper left corners), valid, radiance
    flight: envi.FlightLine | None
    swath: DataFrame | None  # line, sample, x, y

    @property
    def central_meridian(self) -> float:
        zone = re.search(r"zone (\d+)", self.projection)
        if not zone:
            raise ValueError(f"not a zone of transverse Mercator: {self.projection}")
        return 6.0 * int(zone[1]) - 183

    @property
    def false_northing(self) -> float:
        return 1e7 if "south" in self.projection.lower() else 0.0


def _numbers(value) -> list[float]:
    return [float(x) for x in (value if isinstance(value, list) else re.split(r"[,\s]+", value.strip("{} "))) if str(x).strip()]


def _files(spark: SparkSession, folder: str) -> dict[str, str]:
    """The folder's files by kind: a handful of names."""
    found = {}
    for (path,) in spark.read.format("binaryFile").load(folder).select("path").collect():
        for kind in (".pix.hdr", ".pix", ".glu.hdr", ".glu", "Navcor_sum.log"):
            if path.endswith(kind):
                found[kind] = re.sub(r"^file:/+", "/", path)
    for kind in (".pix.hdr", ".pix"):
        if kind not in found:
            raise ValueError(f"{folder} holds no {kind} file")
    return found


def window_of(spark: SparkSession, affine: Sequence[float], projection: str, la: Layout, box: Sequence[float]) -> tuple[int, int, int, int]:
    """Rows and columns whose corners lie between the projected corners of a box (lon0, lat0, lon1, lat1)."""
    zone = int(re.search(r"zone (\d+)", projection)[1])
    y0 = 1e7 if "south" in projection.lower() else 0.0
    ends = spark.createDataFrame([(float(box[0]), float(box[1])), (float(box[2]), float(box[3]))], "lon double, lat double")
    px, py = geo.tm_forward(F.col("lat"), F.col("lon"), 6.0 * zone - 183, y0=y0)
    at = ends.agg(F.min(px), F.min(py), F.max(px), F.max(py)).first()
    x, y = affine[2] + np.arange(la.samples) * affine[0], affine[5] + np.arange(la.lines) * affine[4]
    cols, rows = np.flatnonzero((x >= at[0]) & (x <= at[2])), np.flatnonzero((y >= at[1]) & (y <= at[3]))
    if not len(cols) or not len(rows):
        raise ValueError("the box does not meet the scene")
    return int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1


def open_scene(spark: SparkSession, folder: str, bands: Sequence[int] | None = None, window: Sequence[int] | None = None, box: Sequence[float] | None = None, block: int = 256) -> Scene:
    """A scene, or a window of it: (row0, row1, col0, col1), ends excluded, or a box (lon0, lat0, lon1, lat1).

    Rows and columns stay those of the whole scene.
    """
    files = _files(spark, folder)
    h = envi.read_header(spark, files[".pix.hdr"])
    la = resolved(files[".pix"], layout(h))
    placed = envi.parse_map_info(h["map info"])
    if placed is None:
        raise ValueError("map info that does not start at the upper left pixel")
    affine, projection = placed
    if box is not None:
        window = window_of(spark, affine, projection, la, box)
    window = tuple(window) if window is not None else (0, la.lines, 0, la.samples)
    if not (0 <= window[0] <= window[1] <= la.lines and 0 <= window[2] <= window[3] <= la.samples):
        raise ValueError(f"{window} is not inside the scene")
    wavelengths = _numbers(h["wavelength"])
    chosen = list(bands) if bands is not None else list(range(la.bands))
    fwhm = _numbers(h["fwhm"]) if "fwhm" in h else None
    bad = _numbers(h["bbl"]) if "bbl" in h else [1.0] * la.bands
    stated = next(v for k, v in h.items() if "scale" in k)
    scale = 1 / int(stated) if re.fullmatch(r"\s*\d+\s*", stated) else float(stated)
    ignore = h.get("data ignore value", "")
    nodata = float(ignore) if ignore.strip() else -99999.0

    raw = blocks(spark, files[".pix"], la, chosen, window, block)
    x, y = geo.grid_xy(F.col("col"), F.col("row"), affine, "ul")
    px = raw.select("row", "col", x.alias("x"), y.alias("y"), (F.col("first") != nodata).alias("valid"), scene.decode_radiance(F.col("counts"), scale, nodata).alias("radiance"))
    flight = swath = None
    if all(k in files for k in (".glu", ".glu.hdr", "Navcor_sum.log")):
        flight = envi.read_flight_line(spark, files["Navcor_sum.log"], files[".glu.hdr"])
        gl = resolved(files[".glu"], layout(envi.read_header(spark, files[".glu.hdr"])))
        if (gl.samples, gl.lines) != (flight.samples, flight.lines):
            raise ValueError("ground positions that do not match the flight line")
        at = blocks(spark, files[".glu"], gl, [1], (0, gl.lines, 0, gl.samples), block)
        swath = at.select(F.col("row").alias("line"), F.col("col").alias("sample"), F.col("first").alias("x"), F.get("counts", F.lit(0)).alias("y"))
    taken = re.match(r"(.*)(?=-L|-N)", files[".pix"].rsplit("/", 1)[1])
    pick = lambda v: [v[i] for i in chosen]
    return Scene(taken[0] if taken else files[".pix"].rsplit("/", 1)[1][:-4], h, affine, projection, pick(wavelengths), fwhm and pick(fwhm), [v == 1 for v in pick(bad)], h.get("acquisition time"), window, px, flight, swath)


ANGLES = ("view_zenith", "view_azimuth", "sample_index", "line_index")


def with_geometry(s: Scene) -> DataFrame:
    """Pixels with view angles and swath places, NULL where the first band is missing, and the sun's.

    A swath sample falls into the cell that holds it, a later line over an earlier one, and into none if its position is
    missing; cells between are filled along the window's rows, then its columns. Without a flight line the view angles are NULL.
    """
    px = s.pixels
    if s.swath is None:
        out = px.withColumns({c: F.lit(None).cast("double") for c in ANGLES})
    else:
        f = s.flight
        zenith, azimuth = geo.view_angles(F.col("sample"), f.samples, f.resolution, f.height, f.heading)
        row, col = geo.grid_rowcol(F.col("x"), F.col("y"), s.affine)
        r0, r1, c0, c1 = s.window
        known = s.swath.where("not isnan(x) and not isnan(y)")  # NaN would turn to cell 0
        there = known.withColumns({"row": row.cast("int"), "col": col.cast("int"), "at": F.struct(zenith.alias("view_zenith"), azimuth.cast("double").alias("view_azimuth"), F.col("sample").cast("double").alias("sample_index"), F.col("line").cast("double").alias("line_index"))})
        there = there.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
        grid = raster.scattered(px.select("row", "col"), raster.scatter_last(there, "at"), ["at"])
        filled = _filled(grid)
        out = px.join(filled, ["row", "col"], "left")
        out = out.select(*px.columns, *[F.when(F.col("valid"), F.col("at")[c]).alias(c) for c in ANGLES])
    if s.acquired is None:
        return out
    lat, lon = geo.tm_inverse(F.col("x"), F.col("y"), s.central_meridian, y0=s.false_northing)
    out = out.withColumns({"lat": lat, "lon": lon, "acquired": F.lit(s.acquired.rstrip("Zz")).cast("timestamp_ntz")})
    out = geo.with_sun_position(out, "acquired", "lat", "lon", valid=F.col("valid"))
    return out.withColumn("relative_azimuth", geo.relative_azimuth(F.col("view_azimuth"), F.col("sun_azimuth")))


def _filled(grid: DataFrame) -> DataFrame:
    """``raster.fill_gaps`` of all four at once: they are missing together."""
    from pyspark.sql import Window

    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    past, ahead = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    for w, f, frame in ((row, F.last, past), (col, F.last, past), (row, F.first, ahead), (col, F.last, past)):
        grid = grid.withColumn("at", f("at", ignorenulls=True).over(w.rowsBetween(*frame)))
    return grid

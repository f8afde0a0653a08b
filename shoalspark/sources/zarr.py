"""Chunked arrays in folders (the Zarr format, version 2), read as rows and written from pixels.

``read_window()`` reads the chunks that meet a range of indices, and no others, through Spark's own file reader, so
from any store that Hadoop knows. ``spark.read.format("zarr_array")`` is the same as a data source, one partition a
chunk, over a folder that all executors share. Options: path, array, and i0, i1, .. for the range of an index
("first:last"). Rows: i0, i1, .. (the indices), value; the fill value is NULL. Chunks may be plain, zlib or Zstandard.
Ranges are options and not pushed filters: Spark 4.1.2 keeps the filters pushed into a Python source for later queries
of the same DataFrame, whose rows are then missing. ``spark.write.format("zarr_region")`` puts cells into chunks that are there already, all or none.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.utils import AnalysisException


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def attributes(path: str, array: str = "") -> dict:
    """Attributes of a group or of one of its arrays; an error if there is no group."""
    if not os.path.isdir(path):
        raise FileNotFoundError(f"{path} is not a folder")
    at = os.path.join(path, array, ".zattrs")
    return read_json(at) if os.path.exists(at) else {}


def _inflate(raw: bytes, codec: dict | None) -> bytes:
    if codec is None:
        return raw
    if codec["id"] in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if codec["id"] == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"chunks packed by {codec['id']} can't be read")


def unpack(raw: bytes, meta: dict, at: Sequence[int]) -> np.ndarray:
    """A chunk's values, cut to the array."""
    values = np.frombuffer(_inflate(raw, meta["compressor"]), meta["dtype"]).reshape(meta["chunks"], order=meta["order"])
    return values[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(at, meta["chunks"], meta["shape"]))]


def chunk_name(meta: dict, at: Sequence[int]) -> str:
    return meta.get("dimension_separator", ".").join(map(str, at)) if len(at) else "0"


def read_chunk(path: str, meta: dict, at: Sequence[int]) -> np.ndarray | None:
    """A chunk's values; None if it was never written."""
    file = os.path.join(path, chunk_name(meta, at))
    if not os.path.exists(file):
        return None
    with open(file, "rb") as f:
        return unpack(f.read(), meta, at)


Ranges = dict[int, tuple[int, int]]


def cells(got: np.ndarray, meta: dict, at: Sequence[int], ranges: Ranges) -> pa.RecordBatch:
    """A chunk's cells in the ranges (first and last index of a dimension) as rows: i0, i1, .., value."""
    cut, first = [], []
    for k, (n, c) in enumerate(zip(got.shape, meta["chunks"])):
        lo, hi = ranges.get(k, (0, meta["shape"][k] - 1))
        start, end = max(lo - at[k] * c, 0), min(hi - at[k] * c, n - 1)
        cut.append(slice(start, end + 1)), first.append(at[k] * c + start)
    got = got[tuple(cut)]
    values, fill = got.ravel().astype(float), meta["fill_value"]
    missing = np.isnan(values) if fill in (None, "NaN") else (values == float(fill)) | np.isnan(values)
    places = np.indices(got.shape).reshape(got.ndim, -1)
    return pa.RecordBatch.from_arrays([*(pa.array(p + f) for p, f in zip(places, first)), pa.array(values, pa.float64(), mask=missing)], names=[*(f"i{k}" for k in range(got.ndim)), "value"])


def _schema(meta: dict) -> str:
    return ", ".join([f"i{k} long" for k in range(len(meta["shape"]))] + ["value double"])


def _chunks(meta: dict, ranges: Ranges) -> list[range]:
    """Of each dimension, the chunks that meet its range."""
    out = []
    for k, (n, c) in enumerate(zip(meta["shape"], meta["chunks"])):
        lo, hi = ranges.get(k, (0, n - 1))
        out.append(range(max(lo, 0) // c, min(hi, n - 1) // c + 1))
    return out


class ZarrArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr_array"

    def schema(self) -> str:
        return _schema(read_json(os.path.join(self.options["path"], self.options["array"], ".zarray")))

    def reader(self, schema) -> DataSourceReader:
        ranges = {int(k[1:]): tuple(map(int, v.split(":"))) for k, v in self.options.items() if k[:1] == "i" and k[1:].isdigit()}
        return _Reader(os.path.join(self.options["path"], self.options["array"]), ranges)


class _Reader(DataSourceReader):
    def __init__(self, path: str, ranges: Ranges):
        self.path, self.meta, self.ranges = path, read_json(os.path.join(path, ".zarray")), ranges

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in itertools.product(*_chunks(self.meta, self.ranges))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        got = read_chunk(self.path, self.meta, partition.value) if partition else None  # no chunk wanted: one partition of none
        if got is not None:
            yield cells(got, self.meta, partition.value, self.ranges)


def array_source(spark: SparkSession, path: str, array: str, ranges: Ranges | None = None) -> DataFrame:
    """The data source over a range of each index."""
    spark.dataSource.register(ZarrArray)
    return spark.read.format("zarr_array").options(path=path, array=array, **{f"i{k}": f"{a}:{b}" for k, (a, b) in (ranges or {}).items()}).load()


def stored_json(spark: SparkSession, path: str) -> dict | None:
    """A small file of any store that Hadoop knows; None if it is not there."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return json.loads(sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def metadata(spark: SparkSession, path: str, array: str) -> dict:
    """An array's shape, chunks and packing: from the group's consolidated metadata if it has any, one file for all arrays."""
    whole = stored_json(spark, f"{path}/.zmetadata")
    meta = whole["metadata"].get(f"{array}/.zarray") if whole else stored_json(spark, f"{path}/{array}/.zarray")
    if meta is None:
        raise FileNotFoundError(f"{path} holds no array {array}")
    return meta


def read_window(spark: SparkSession, path: str, array: str, ranges: Ranges | None = None) -> DataFrame:
    """Rows (i0, i1, .., value) of an array's cells in ``ranges`` (dimension: first and last index), or of all of it.

    Spark's binary file reader gets a pattern that names just the chunks that meet the ranges; an array without a
    dimension and chunks that were never written give no rows.
    """
    meta, ranges = metadata(spark, path, array), dict(ranges or {})
    wanted = _chunks(meta, ranges)
    none = spark.createDataFrame([], _schema(meta))
    if not wanted or not all(wanted):
        return none
    part = "{%s}"
    names = meta.get("dimension_separator", ".").join(part % ",".join(map(str, r)) for r in wanted)
    try:
        files = spark.read.format("binaryFile").load(f"{path}/{array}/{names}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return none
        raise

    def run(batches):
        for b in batches:
            for where, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                at = [int(x) for x in where.rsplit(f"/{array}/", 1)[1].replace("/", ".").split(".")]
                yield cells(unpack(raw, meta, at), meta, at, ranges)

    return files.select("path", "content").mapInArrow(run, _schema(meta))


def open_scene(spark: SparkSession, path: str, array: str, bands: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, wl_idx, wavelength, x, y, value) of an array over (wavelength, y, x); a window of it reads its chunks only."""
    window = {k: r for k, r in enumerate((bands, rows, cols)) if r is not None}
    axis = lambda a, i: read_window(spark, path, a).select(F.col("i0").alias(i), F.col("value").alias(a))
    cube = read_window(spark, path, array, window).select(F.col("i0").alias("wl_idx"), F.col("i1").alias("row"), F.col("i2").alias("col"), "value")
    # the axes are as long as the scene's sides: some thousand numbers
    return cube.join(F.broadcast(axis("wavelength", "wl_idx")), "wl_idx").join(F.broadcast(axis("x", "col")), "col").join(F.broadcast(axis("y", "row")), "row")


def _write_array(path: str, values: np.ndarray, dims: Sequence[str], attrs: dict | None = None) -> None:
    os.makedirs(path, exist_ok=True)
    meta = {"zarr_format": 2, "shape": list(values.shape), "chunks": [max(1, n) for n in values.shape], "dtype": values.dtype.str, "compressor": None, "fill_value": None, "order": "C", "filters": None}
    with open(os.path.join(path, ".zarray"), "w", encoding="utf-8") as f:
        json.dump(meta, f)
    with open(os.path.join(path, ".zattrs"), "w", encoding="utf-8") as f:
        json.dump({"_ARRAY_DIMENSIONS": list(dims)} | (attrs or {}), f)
    with open(os.path.join(path, ".".join("0" for _ in values.shape) or "0"), "wb") as f:
        f.write(values.tobytes())


def write_scene(pixels: DataFrame, spectrum: str, wavelengths: Sequence[float], affine: Sequence[float], shape: tuple[int, int], path: str, array: str, crs_wkt: str = "", tile: int = 256, attrs: dict | None = None, band_chunk: int | None = None) -> None:
    """Pixels (row, col, spectrum) as one array over (wavelength, y, x), with axes, grid mapping and conventions.

    Chunks are ``tile`` cells a side and ``band_chunk`` bands deep (all, if not given), so that windows of few bands
    need not read the others. The driver writes the axes and the small files, executors the chunks.
    """
    height, width = shape
    a, b, c, d, e, f = map(float, affine)
    os.makedirs(path, exist_ok=True)
    for name, content in ((".zgroup", {"zarr_format": 2}), (".zattrs", {"Conventions": "CF-1.8"} | (attrs or {}))):
        write_json(os.path.join(path, name), content)
    grid = {"crs_wkt": crs_wkt, "spatial_ref": crs_wkt, "GeoTransform": f"{c} {a} {b} {f} {d} {e}"}
    _write_array(os.path.join(path, "wavelength"), np.array(wavelengths, "<f8"), ["wavelength"])
    _write_array(os.path.join(path, "x"), c + a * (np.arange(width) + 0.5), ["x"])
    _write_array(os.path.join(path, "y"), f + e * (np.arange(height) + 0.5), ["y"])
    _write_array(os.path.join(path, "spatial_ref"), np.array(0, "<i4"), [], grid)
    add_array(path, array, (len(wavelengths), height, width), (band_chunk or len(wavelengths), tile, tile), ["wavelength", "y", "x"])
    write_region(pixels, spectrum, path, array)


def write_json(path: str, content: dict) -> None:
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(content, f)
    os.replace(f"{path}.part", path)


def add_array(path: str, array: str, shape: Sequence[int], chunks: Sequence[int], dims: Sequence[str], dtype: str = "<f4", attrs: dict | None = None) -> None:
    """A new, empty array in a scene that is there already: its description only, no chunk is written."""
    os.makedirs(os.path.join(path, array), exist_ok=True)
    fill = "NaN" if np.dtype(dtype).kind == "f" else int(np.iinfo(dtype).min)
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}
    write_json(os.path.join(path, array, ".zarray"), meta)
    write_json(os.path.join(path, array, ".zattrs"), {"_ARRAY_DIMENSIONS": list(dims), "grid_mapping": "spatial_ref"} | (attrs or {}))
    consolidate(path)


def consolidate(path: str) -> None:
    """All descriptions of a group in one file, which a reader then asks for alone."""
    found = {}
    for folder in ["", *sorted(n for n in os.listdir(path) if os.path.isdir(os.path.join(path, n)))]:
        for name in (".zgroup", ".zarray", ".zattrs"):
            if os.path.exists(at := os.path.join(path, folder, name)):
                found["/".join(x for x in (folder, name) if x)] = read_json(at)
    write_json(os.path.join(path, ".zmetadata"), {"zarr_consolidated_format": 1, "metadata": found})


# --- regions ------------------------------------------------------------------------------


def write_region(pixels: DataFrame, value: str, path: str, array: str) -> None:
    """Cells (row, col, value) into an array over (y, x), or spectra into one over (wavelength, y, x), in place.

    Cells that are not among ``pixels`` keep what they hold; a NULL is written as missing. Rows are dealt by tile, a
    task holds one tile at a time. New chunks stand beside the old ones until every task is done; then all take their
    places. If a task fails for good, all are removed and the scene is as it was.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(ZarrRegion)
    meta = read_json(os.path.join(path, array, ".zarray"))
    th, tw = meta["chunks"][-2:]
    v = F.array(F.col(value).cast("double")) if len(meta["shape"]) == 2 else F.col(value).cast("array<double>")
    tiles = pixels.select(F.floor(F.col("row") / th).cast("int").alias("ty"), F.floor(F.col("col") / tw).cast("int").alias("tx"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), v.alias("v"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = tiles.repartition(n, "ty", "tx").sortWithinPartitions("ty", "tx")
    out.write.format("zarr_region").options(path=path, array=array).mode("append").save()


class ZarrRegion(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr_region"

    def schema(self) -> str:
        return "ty int, tx int, row int, col int, v array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RegionWriter(os.path.join(self.options["path"], self.options["array"]))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _RegionWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.meta = folder, read_json(os.path.join(folder, ".zarray"))
        self.mark = f".new-{os.urandom(8).hex()}"  # of this write: what a dead task has left is found by it

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names, tile, rows = [], None, []
        for batch in iterator:
            keys = list(zip(batch.column("ty").to_pylist(), batch.column("tx").to_pylist()))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a < b and keys[a] != tile:
                    names += self._store(tile, rows)
                    tile, rows = keys[a], []
                rows.append(batch.slice(a, b - a))
        return _Written(names + self._store(tile, rows))

    def _store(self, tile, rows: list[pa.RecordBatch]) -> list[str]:
        if tile is None:
            return []
        meta, names = self.meta, []
        *_, th, tw = meta["chunks"]
        table = pa.Table.from_batches(rows)
        at = table.column("row").to_numpy() - tile[0] * th, table.column("col").to_numpy() - tile[1] * tw
        depth = meta["shape"][0] if len(meta["shape"]) == 3 else 1
        fill = np.nan if meta["fill_value"] == "NaN" else meta["fill_value"]
        values = np.full((len(table), depth), np.nan)
        for k, v in enumerate(table.column("v").to_pylist()):
            if v is not None:
                values[k, : len(v)] = [np.nan if x is None else x for x in v]
        values = np.where(np.isnan(values), fill, values)
        bands = meta["chunks"][0] if depth > 1 or len(meta["shape"]) == 3 else 1
        for z in range(math.ceil(depth / bands)):
            where = (z, *tile) if len(meta["shape"]) == 3 else tile
            chunk = np.full((bands, th, tw), fill, meta["dtype"])
            old = read_chunk(self.folder, meta, where)
            if old is not None:
                old = old.reshape(-1, *old.shape[-2:])
                chunk[: old.shape[0], : old.shape[1], : old.shape[2]] = old
            part = values[:, z * bands : (z + 1) * bands]
            chunk[: part.shape[1], at[0], at[1]] = part.T
            name = chunk_name(meta, where)
            os.makedirs(os.path.dirname(os.path.join(self.folder, name)), exist_ok=True)
            new = f"{name}{self.mark}-{os.urandom(4).hex()}"
            with open(os.path.join(self.folder, new), "wb") as f:
                f.write(zlib.compress(chunk.tobytes(), 1) if meta["compressor"] else chunk.tobytes())
            names.append(new)
        return names

    def commit(self, messages) -> None:
        for m in messages:
            for new in m.names if m else []:
                os.replace(os.path.join(self.folder, new), os.path.join(self.folder, new.split(self.mark)[0]))
        self._clear()  # what an earlier attempt of a task has left

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for top, _, names in os.walk(self.folder):
            for n in names:
                if self.mark in n:
                    os.remove(os.path.join(top, n))

"""Text headers of ENVI rasters, map info and flight-line logs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = re.compile(r"^\s*([^={}\n]+?)\s*=\s*(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^\n]*)", re.M)


def parse_header(text: str) -> dict:
    """``key = value`` and ``key = {..}`` entries, keys in lower case; lists are split; a description's entries are merged in."""
    out: dict = {}
    for key, value in _ENTRY.findall(text):
        key, value = key.strip().lower(), value.strip()
        if value.startswith("{"):
            inner = value[1:-1].strip()
            if key == "description" and "=" in inner:
                out |= parse_header(inner.replace(",", "\n"))
                out[key] = inner
            else:
                out[key] = [x.strip() for x in inner.split(",")] if "," in inner else inner
        else:
            out[key] = value
    return out


def read_header(spark: SparkSession, path: str) -> dict:
    """A header is one small file; its bytes are read by Spark, whatever the store."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return parse_header(_decoded(bytes(raw)))


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def read_headers(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A row a header file: path, entries (lists of words; single values are lists of one), and the affine and projection of its map info."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            found = [parse_header(_decoded(bytes(x))) for x in b.column("content").to_pylist()]
            entries = [[(k, v if isinstance(v, list) else [v]) for k, v in h.items()] for h in found]
            maps = [parse_map_info(h["map info"]) if "map info" in h else None for h in found]
            yield pa.RecordBatch.from_arrays([
                b.column("path"), pa.array(entries, pa.map_(pa.string(), pa.list_(pa.string()))),
                pa.array([m and [float(x) for x in m[0]] for m in maps], pa.list_(pa.float64())), pa.array([m and m[1] for m in maps], pa.string()),
            ], names=["path", "entries", "affine", "projection"])

    return files.mapInArrow(run, "path string, entries map<string,array<string>>, affine array<double>, projection string")


def parse_map_info(info: list[str] | str) -> tuple[tuple[float, ...], str] | None:
    """(affine, projection) of ENVI map info; None unless the reference pixel is (1, 1)."""
    f = [x.strip() for x in (info if isinstance(info, list) else info.strip("{} ").split(","))]
    if float(f[1]) != 1 or float(f[2]) != 1:
        return None
    x, y, dx, dy = map(float, f[3:7])
    rotation = next((float(v.split("=")[1]) for v in f if v.lower().startswith("rotation")), 0.0)
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    zone = f" zone {f[7]} {f[8]}" if f[0].lower() == "utm" and len(f) > 8 else ""
    return (dx * c, dx * s, x, dy * s, -dy * c, y), f[0] + zone


@dataclass(frozen=True)
class FlightLine:
    samples: int
    lines: int
    resolution: float
    height: float
    heading: float
    roll: float = 0.0


def read_flight_line(spark: SparkSession, nav: str, header: str) -> FlightLine:
    """Average height and heading from the navigation log; size and pixel from the header.

    The log's averages are roll, pitch, heading, distance, height, easting and northing; a line of fewer numbers ends in
    height and heading. Sensors are taken as levelled: the averages of roll and pitch are not used.
    """
    h = read_header(spark, header)
    found = spark.read.text(nav).where(F.col("value").contains("Average Value")).limit(1).collect()
    if not found:
        raise ValueError(f"no average line in {nav}")
    numbers = [float(x) for x in re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", found[0][0])]
    height, heading = (numbers[4], numbers[2]) if len(numbers) >= 7 else numbers[-2:]
    size = h.get("pixel size", "1")
    resolution = float(h["map info"][5]) if "map info" in h else float(size[0] if isinstance(size, list) else size)
    return FlightLine(int(h["samples"]), int(h["lines"]), resolution, height, heading)

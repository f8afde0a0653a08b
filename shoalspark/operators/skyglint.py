"""Sky and sun light mirrored by a wind-roughened sea (Zhang et al. 2017): spectral reflectance for a scene's geometry.

The sky is a table of patches (a polar cap, then quadrangles) with their radiance by sun zenith, aerosol optical depth
and wavelength; facets are spread as Cox & Munk have it. A patch's weight is the share of facets that turn its light
into the sensor; its light is weakened by Fresnel's reflectance at the mean angle. All patches are taken together as
arrays. Geometry is a scene's, so one spectrum is computed and joined to the pixels as one row.

``archive_glint()`` does so for all scenes of an archive in one plan, from tables kept node by node: a scene reads the
four nodes round its sun and aerosol and sums them in Spark, a row a patch, so that no table comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as ph
from .lut import bracket


@dataclass
class SkyTables:
    """Patches of the sky (first the cap) with centres and widths in radians, and radiance over (sun zenith, depth, patch, wavelength)."""

    zenith: np.ndarray
    azimuth: np.ndarray
    d_cosine: float
    d_azimuth: float
    sun_zenith: np.ndarray
    depth: np.ndarray
    wavelength: np.ndarray
    sky: np.ndarray
    sun: np.ndarray  # sun zenith, depth, wavelength
    disk: float = np.radians(0.266)
    vector_ratio: np.ndarray | None = None  # by wavelength, 1 if polarisation is left out


def direction(zenith: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """Unit vectors, last axis x, y, z."""
    return np.stack(np.broadcast_arrays(np.sin(zenith) * np.cos(azimuth), np.sin(zenith) * np.sin(azimuth), np.cos(zenith)), axis=-1)


def disk(zenith: float, radius: float, n: int = 100) -> np.ndarray:
    """The centre and rim of a disk of the sky round azimuth 0."""
    turn = np.linspace(0, 2 * np.pi, n)
    rim = direction(np.full(n, radius), turn)
    points = np.vstack([[0.0, 0.0, 1.0], rim])
    c, s = np.cos(zenith), np.sin(zenith)
    return points @ np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])


def facet_share(light: np.ndarray, sensor: np.ndarray, wind: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each patch (patches, points, 3), the share of facets that turn its light to the sensor, and the mean angle of incidence.

    The facets between light and sensor span a range of slopes and one of azimuths; slopes follow a Rayleigh law.
    """
    normal = light + sensor
    normal = normal / np.linalg.norm(normal, axis=-1, keepdims=True)
    slope2 = (normal[..., 0] ** 2 + normal[..., 1] ** 2) / normal[..., 2] ** 2
    sigma2 = (0.003 + 0.00512 * wind) / 2
    slopes = np.exp(-slope2.min(axis=-1) / (2 * sigma2)) - np.exp(-slope2.max(axis=-1) / (2 * sigma2))
    a = np.arctan2(normal[..., 1], normal[..., 0])
    span = np.ptp(a, axis=-1)
    # a patch across the cut at 180 degrees spans less when azimuths are taken from 0 to 360
    across = (a.max(axis=-1) * a.min(axis=-1) <= 0) & (np.abs(a) >= np.pi / 2).all(axis=-1)
    span = np.where(across, np.ptp(np.where(a < 0, a + 2 * np.pi, a), axis=-1), span)
    angle = np.arccos(np.clip(np.abs((normal * sensor).sum(axis=-1)), 0, 1)).mean(axis=-1)
    return 2 * slopes * span / (2 * np.pi), angle


def reflectance(index: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Unpolarised Fresnel reflectance (angles, wavelengths)."""
    c = np.cos(angle)[:, None]
    t = np.sqrt(1 - (np.sin(angle)[:, None] / index) ** 2)
    return (((c - index * t) / (c + index * t)) ** 2 + ((index * c - t) / (index * c + t)) ** 2) / 2


def table_at(axes: Sequence[np.ndarray], values: np.ndarray, point: Sequence[float]) -> np.ndarray:
    """Linear in the leading axes; a point outside one of them is an error."""
    for axis, x in zip(axes, point):
        if not axis[0] <= x <= axis[-1]:
            raise ValueError(f"{x} is outside {axis[0]} to {axis[-1]}")
        i = min(max(int(np.searchsorted(axis, x, "right")) - 1, 0), len(axis) - 2)
        w = (x - axis[i]) / (axis[i + 1] - axis[i])
        values = (1 - w) * values[i] + w * values[i + 1]
    return values


def by_wavelength(tables: SkyTables, values: np.ndarray, wavelength: np.ndarray) -> np.ndarray:
    if wavelength.min() < tables.wavelength[0] or wavelength.max() > tables.wavelength[-1]:
        raise ValueError("a wavelength is outside the table")
    return np.stack([np.interp(wavelength, tables.wavelength, v) for v in np.atleast_2d(values)])


def water_index(wavelength: np.ndarray, temperature: float, salinity: float) -> np.ndarray:
    t, s, w = temperature, salinity, wavelength
    return 1.31405 + (1.779e-4 - 1.05e-6 * t + 1.6e-8 * t * t) * s - 2.02e-6 * t * t + (15.868 + 0.01155 * s - 0.00423 * t) / w - 4382 / w**2 + 1.1455e6 / w**3


def sky_and_sun(tables: SkyTables, wavelength: Sequence[float], sun_zenith: float, view_zenith: float, view_azimuth: float, aod: float, wind: float, temperature: float = 17.0, salinity: float = 30.0) -> dict[str, np.ndarray]:
    """Reflectance of sky light, of the sun, and of both, by wavelength. Angles in degrees; the azimuth is the sun's from the view."""
    wl = np.asarray(wavelength, float)
    index = water_index(wl, temperature, salinity)
    sensor = direction(np.radians(view_zenith), np.radians(view_azimuth))
    step = np.linspace(-0.5, 0.5, 10)
    z, a = tables.zenith[1:, None, None], tables.azimuth[1:, None, None]
    quads = direction(z + step[None, :, None] * tables.d_cosine / np.sin(z), a + step[None, None, :] * tables.d_azimuth).reshape(len(z), -1, 3)
    cap, cap_angle = facet_share(disk(0.0, float(tables.zenith[0]) or tables.disk)[None], sensor, wind)
    share, angle = facet_share(quads, sensor, wind)
    share, angle = np.append(cap, share), np.append(cap_angle, angle)
    light = by_wavelength(tables, table_at((tables.sun_zenith, tables.depth), tables.sky, (sun_zenith, aod)), wl)
    toward = direction(np.radians(view_zenith), np.radians(view_azimuth + 180))
    facing = light[(direction(tables.zenith, tables.azimuth) @ toward).argmax()]
    total = share.sum()
    sky = (share[:, None] * reflectance(index, angle) * light / facing).sum(axis=0) / total
    sun_share, sun_angle = facet_share(disk(np.radians(sun_zenith), tables.disk)[None], sensor, wind)
    beam = by_wavelength(tables, table_at((tables.sun_zenith, tables.depth), tables.sun, (sun_zenith, aod)), wl)[0]
    sun = beam / facing * reflectance(index, sun_angle)[0] * sun_share[0] / total
    ratio = 1.0 if tables.vector_ratio is None else np.interp(wl, tables.wavelength, tables.vector_ratio)
    return {"sky": sky, "sun": sun, "rho": sky * ratio + sun}


def load_tables(spark: SparkSession, path: str) -> SkyTables:
    """Tables kept as Parquet: one row a name, its shape and values; read by the driver, some hundred MB at most by their count."""
    meta = spark.read.parquet(path)
    size = meta.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > 1 << 27:
        raise ValueError(f"{size} numbers are too many for one machine: thin the tables out")
    got = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in meta.collect()}
    return SkyTables(**{k: float(v) if k in ("d_cosine", "d_azimuth", "disk") else v for k, v in got.items()})


def save_tables(spark: SparkSession, tables: SkyTables, path: str) -> None:
    rows = [(k, list(np.shape(v)), np.asarray(v, float).ravel().tolist()) for k, v in vars(tables).items() if v is not None]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def scene_glint(pixels: DataFrame, tables: SkyTables, wavelength: Sequence[float], aod: float | None = None) -> DataFrame:
    """``pixels`` with the scene's spectra rho_surface_sky, _sun and _total: of its mean geometry and wind (and AOD), one row for all."""
    mean = pixels.agg(*[F.avg(c).alias(c) for c in ("sun_zenith", "view_zenith", "relative_azimuth", "wind_speed", *(["aod"] if aod is None else []))]).first()
    got = sky_and_sun(tables, wavelength, mean["sun_zenith"], mean["view_zenith"], mean["relative_azimuth"], mean["aod"] if aod is None else aod, mean["wind_speed"])
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return pixels.withColumns({"rho_surface_sky": literal(got["sky"]), "rho_surface_sun": literal(got["sun"]), "rho_surface_total": literal(got["rho"])})


# --- many scenes -----------------------------------------------------------------------


def store_nodes(sky: DataFrame, sun: DataFrame, patches: SkyTables, path: str) -> None:
    """Tables node by node: sky (i_sun, i_depth, patch, radiance by wavelength), sun (i_sun, i_depth, radiance), and what describes them."""
    sky.write.mode("overwrite").parquet(f"{path}/sky")
    sun.write.mode("overwrite").parquet(f"{path}/sun")
    small = {k: np.atleast_1d(np.asarray(v, float)).tolist() for k, v in vars(patches).items() if v is not None and k not in ("sky", "sun")}
    sky.sparkSession.createDataFrame([(small,)], "about map<string,array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def patch_geometry(scenes: DataFrame, key: str, patches: SkyTables) -> DataFrame:
    """(key, patch, share, angle, facing): of every patch (the sun's disk is -1) what its facets do in each scene's geometry."""
    step = np.linspace(-0.5, 0.5, 10)
    z, a = patches.zenith[1:, None, None], patches.azimuth[1:, None, None]
    quads = direction(z + step[None, :, None] * patches.d_cosine / np.sin(z), a + step[None, None, :] * patches.d_azimuth).reshape(len(patches.zenith) - 1, -1, 3)
    cap, centres = disk(0.0, float(patches.zenith[0]) or patches.disk)[None], direction(patches.zenith, patches.azimuth)

    def run(batches):
        for b in batches:
            for k, (sun, view, turn, wind) in enumerate(zip(*(b.column(c).to_pylist() for c in ("sun_zenith", "view_zenith", "relative_azimuth", "wind_speed")))):
                sensor, toward = direction(np.radians(view), np.radians(turn)), direction(np.radians(view), np.radians(turn + 180))
                parts = [facet_share(x, sensor, wind) for x in (disk(np.radians(sun), patches.disk)[None], cap, quads)]
                share, angle = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                n = len(share)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(key).slice(k, 1)] * n), pa.array(np.arange(-1, n - 1), pa.int32()), pa.array(share), pa.array(angle), pa.array(np.append(-2.0, centres @ toward))], names=[key, "patch", "share", "angle", "facing"])

    there = scenes.select(key, *[F.col(c).cast("double").alias(c) for c in ("sun_zenith", "view_zenith", "relative_azimuth", "wind_speed")]).dropna()
    return there.mapInArrow(run, f"`{key}` {scenes.schema[key].dataType.simpleString()}, patch int, share double, angle double, facing double")


def _fresnel(index: Column, angle: Column) -> Column:
    c, t = F.cos(angle), F.sqrt(1 - F.pow(F.sin(angle) / index, F.lit(2.0)))
    return (F.pow((c - index * t) / (c + index * t), F.lit(2.0)) + F.pow((index * c - t) / (index * c + t), F.lit(2.0))) / 2


def archive_glint(scenes: DataFrame, path: str, wavelengths: Sequence[float], key: str = "image_id", temperature: float = 17.0, salinity: float = 30.0) -> DataFrame:
    """(key, wl_idx, wavelength, rho_surface_sky, rho_surface_sun, rho_surface_total) of every scene.

    scenes: key, sun_zenith, view_zenith, relative_azimuth, aod, wind_speed. A scene with a value that is missing, or
    outside the tables' axes, has no rows; a wavelength outside is an error.
    """
    spark = scenes.sparkSession
    about = {k: np.array(v) for k, v in spark.read.parquet(f"{path}/about").first()["about"].items()}  # axes and patches: some thousand numbers
    one = {k: float(about.pop(k)[0]) for k in ("d_cosine", "d_azimuth", "disk")}
    patches = SkyTables(sky=np.empty(0), sun=np.empty(0), **one, **about)
    wl, nodes = np.asarray(wavelengths, float), patches.wavelength
    if wl.min() < nodes[0] or wl.max() > nodes[-1]:
        raise ValueError("a wavelength is outside the table")
    k = np.clip(np.searchsorted(nodes, wl, "right") - 1, 0, len(nodes) - 2)
    t, ratio = (wl - nodes[k]) / (nodes[k + 1] - nodes[k]), np.ones(len(wl)) if patches.vector_ratio is None else np.interp(wl, nodes, patches.vector_ratio)
    band = F.array(*[F.struct(F.lit(i).alias("wl_idx"), F.lit(float(w)).alias("wavelength"), F.lit(int(a)).alias("k"), F.lit(float(b)).alias("t"), F.lit(float(r)).alias("ratio")) for i, (w, a, b, r) in enumerate(zip(wl, k, t, ratio))])

    d = scenes.select(key, "sun_zenith", "aod")
    for name, column, axis in (("i_sun", "sun_zenith", patches.sun_zenith), ("i_depth", "aod", patches.depth)):
        i, w = bracket(F.col(column), axis.tolist())
        d = d.withColumn(f"__{name}", F.explode(F.filter(F.array(F.struct(i.alias("i"), (1 - w).alias("w")), F.struct((i + 1).alias("i"), w.alias("w"))), lambda x: x["w"] > 0)))
    d = d.select(key, F.col("__i_sun.i").alias("i_sun"), F.col("__i_depth.i").alias("i_depth"), (F.col("__i_sun.w") * F.col("__i_depth.w")).alias("__w"))

    def summed(table: DataFrame, *by: str) -> DataFrame:
        met = d.join(table, ["i_sun", "i_depth"]).groupBy(key, *by).agg(F.collect_list(F.struct("__w", "radiance")).alias("c"))  # four nodes at most
        zero = F.transform(F.get("c", F.lit(0))["radiance"], lambda _: F.lit(0.0))
        return met.select(key, *by, F.aggregate("c", zero, lambda acc, x: F.zip_with(acc, x["radiance"], lambda a, b: a + x["__w"] * b)).alias("light"))

    sun = summed(spark.read.parquet(f"{path}/sun")).withColumn("patch", F.lit(-1))
    light = summed(spark.read.parquet(f"{path}/sky"), "patch").unionByName(sun)
    rows = light.join(patch_geometry(scenes, key, patches), [key, "patch"]).select(key, "patch", "share", "angle", "facing", "light", F.inline(band))
    at = F.get("light", F.col("k")) * (1 - F.col("t")) + F.get("light", F.col("k") + 1) * F.col("t")
    rows = rows.withColumn("light", at).withColumn("r", F.col("share") * _fresnel(ph.water_index(F.col("wavelength"), temperature, salinity), F.col("angle")) * F.col("light"))
    of = lambda disk_, x: F.sum(F.when((F.col("patch") < 0) == F.lit(disk_), F.col(x)))
    total = rows.groupBy(key, "wl_idx", "wavelength", "ratio").agg(of(False, "r").alias("sky"), of(True, "r").alias("sun"), of(False, "share").alias("share"), F.max_by("light", F.struct("facing", -F.col("patch"))).alias("facing"))
    part = lambda x: F.col(x) / F.col("facing") / F.col("share")
    return total.select(key, "wl_idx", "wavelength", part("sky").alias("rho_surface_sky"), part("sun").alias("rho_surface_sun"), (part("sky") * F.col("ratio") + part("sun")).alias("rho_surface_total"))

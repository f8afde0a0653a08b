"""Radiance to reflectance to water-leaving reflectance, and matchups.

Radiance to water-leaving reflectance is one projection over the pixels: scene
scalars are literals, and the atmosphere's tables, bound to the scene, are one
row of checked size that goes to all tasks. No pixel is shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..operators import lut, matchup, spectral
from ..storage import materialize

GREEN, NIR = 550.0, 800.0


def solar_f0(bands: DataFrame, spectrum: DataFrame, doy: int) -> DataFrame:
    """Band solar irradiance: Gaussian-weighted mean within four sigma, Earth-Sun distance, times 100.

    bands: band, wavelength, fwhm. spectrum: wl, ssi. The range join is keyed by
    10 nm bins, so wide spectra are not compared with every band.
    """
    half = 4 * F.col("fwhm") / 2.3548200450309493
    b = bands.withColumn("bin", F.explode(F.sequence(F.floor((F.col("wavelength") - half) / 10), F.floor((F.col("wavelength") + half) / 10))))
    s = spectrum.withColumn("bin", F.floor(F.col("wl") / 10))
    w = ph.gaussian_response(F.col("wl"), F.col("wavelength"), F.col("fwhm"))
    out = b.join(s, "bin").withColumn("w", w).where("w is not null").groupBy("band", "wavelength").agg((F.sum(F.col("ssi") * F.col("w")) / F.sum("w")).alias("f0"))
    return out.withColumn("f0", F.col("f0") * 100 * ph.earth_sun_factor(F.lit(float(doy))))


def l1r(pixels: DataFrame, wavelengths: Sequence[float], f0: Sequence[float] | Column, gain: Sequence[float] | None = None, offset: Sequence[float] | None = None) -> DataFrame:
    """rho_at_sensor, ndwi and mask_water in one projection."""
    g, n = spectral.nearest_band(wavelengths, GREEN), spectral.nearest_band(wavelengths, NIR)
    out = pixels.withColumn("rho_at_sensor", ph.toa_reflectance("radiance", f0 if isinstance(f0, Column) else list(f0), F.col("sun_zenith"), gain, offset))
    out = out.withColumn("ndwi", ph.ndwi(F.get("rho_at_sensor", F.lit(g)), F.get("rho_at_sensor", F.lit(n))))
    return out.withColumn("mask_water", ph.water_mask(F.col("ndwi")))


def with_atmosphere(pixels: DataFrame, aerosol: DataFrame, aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, scene: Mapping[str, float]) -> DataFrame:
    """``pixels`` with an array by band of each of the atmosphere's terms, from tables bound to the scene."""
    out = pixels
    for nodes, spec in ((aerosol, aerosol_spec), (gas, gas_spec)):
        out = lut.lookup_arrays(out, *lut.bind(nodes, spec, {k: v for k, v in scene.items() if k in spec.axes}))
    return out


def atmosphere(pixels: DataFrame, key: Sequence[str], aerosol: DataFrame, aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, scene: Mapping[str, float]) -> DataFrame:
    """with_atmosphere(), the key and the terms only."""
    axes = pixels.select(*key, *[c for c in lut.PIXEL_AXES if c not in key])
    return with_atmosphere(axes, aerosol, aerosol_spec, gas, gas_spec, scene).select(*key, *aerosol_spec.outputs, *gas_spec.outputs)


def surface(df: DataFrame, wavelengths: Sequence[float], exact: bool = False) -> DataFrame:
    """Surface and water-leaving reflectance, and the NIR glint correction of the latter.

    df has rho_at_sensor, mask_water, and path, t_ra, s_ra, glint (aerosol) and t_gas (gas) arrays.
    """
    nir = spectral.nearest_band(wavelengths, NIR)
    fresnel = [((1 - _index(w)) / (1 + _index(w))) ** 2 for w in wavelengths]
    out = df.withColumn("rho_s", ph.each(lambda r, g, p, t, s: ph.atmosphere_inverse(r, g, p, t, s, exact), F.col("rho_at_sensor"), F.col("t_gas"), F.col("path"), F.col("t_ra"), F.col("s_ra")))
    out = out.withColumn("rho_w", F.when(F.col("mask_water") == 1, ph.each(lambda s, g: s - g, "rho_s", "glint")))
    return out.withColumn("rho_w_gl21", ph.glint_from_nir("rho_w", fresnel, nir))


def l2r(l1: DataFrame, atm: DataFrame, key: Sequence[str], wavelengths: Sequence[float], exact: bool = False) -> DataFrame:
    """surface() of pixels whose terms come from another table, joined by key."""
    return surface(l1.join(atm, list(key), "left"), wavelengths, exact)


def l1_to_l2(pixels: DataFrame, wavelengths: Sequence[float], f0: Sequence[float], aerosol: DataFrame, aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, scene: Mapping[str, float], gain: Sequence[float] | None = None, offset: Sequence[float] | None = None, exact: bool = False) -> DataFrame:
    """Radiance to reflectance at the sensor, the surface and the water, calibrated if a model is given."""
    return surface(with_atmosphere(l1r(pixels, wavelengths, f0, gain, offset), aerosol, aerosol_spec, gas, gas_spec, scene), wavelengths, exact)


def l2w(pixels: DataFrame, wavelengths: Sequence[float], reflectance: str = "rho_w") -> DataFrame:
    """The NIR glint correction of an existing product."""
    fresnel = [((1 - _index(w)) / (1 + _index(w))) ** 2 for w in wavelengths]
    return pixels.withColumn("rho_w_gl21", ph.glint_from_nir(reflectance, fresnel, spectral.nearest_band(wavelengths, NIR)))


def _index(wl: float, t: float = 12.0, s: float = 30.0) -> float:
    flat = 1.31405 + (1.779e-4 - 1.05e-6 * t + 1.6e-8 * t * t) * s - 2.02e-6 * t * t
    return flat + (15.868 + 0.01155 * s - 0.00423 * t) / wl - 4382 / wl**2 + 1.1455e6 / wl**3


def matchups(pixels: DataFrame, atm_long: DataFrame, insitu: DataFrame, points: DataFrame, scene_time: str, hours: float = 12.0, land: bool = False, tile: int = 16) -> DataFrame:
    """Calibration matchups: window pixels, the atmosphere's terms and the in-situ reflectance carried to the sensor.


    pixels: long table (row, col, x, y, image_name, wavelength, rho_t, acq_time).
    points: uuid with its window (row0, row1, col0, col1). atm_long: row, col,
    wavelength, path, t_ra, s_ra, glint, t_gas. insitu: uuid, date_time, wavelength, rho.
    """
    bands = pixels.select("wavelength").distinct()
    grid = insitu.select("uuid").distinct().crossJoin(bands)  # a row a point and band of the sensor
    rho = spectral.interpolate(grid, "wavelength", insitu, "wavelength", "rho", "rho_w", "flat", by=["uuid"])
    near = _near(pixels, insitu.groupBy("uuid").agg(F.collect_set("date_time").alias("__times")), points, scene_time, hours, tile)
    return _carried(near.join(rho, ["uuid", "wavelength"]).join(atm_long, ["row", "col", "wavelength"]), land)


def _carried(near: DataFrame, land: bool) -> DataFrame:
    hat = ph.surface_to_sensor(F.col("rho_w"), F.col("glint"), F.lit(land), F.col("t_gas"), F.col("path"), F.col("t_ra"), F.col("s_ra"))
    return near.select("uuid", "image_name", F.lit(land).alias("land"), "x", "y", "wavelength", "rho_t", hat.alias("rho_t_hat"), "rho_w", F.col("glint").alias("sky_glint"), F.col("path").alias("rho_path"), "t_ra", "s_ra", F.col("t_gas").alias("t_g"))


def _near(pixels: DataFrame, timed: DataFrame, points: DataFrame, scene_time: str, hours: float, tile: int) -> DataFrame:
    """Pixels in the windows of points near in time; ``timed``: uuid, its ``__times`` and what else the pixels shall get."""
    near = matchup.window_join(pixels, points.join(timed, "uuid"), tile).withColumn("date_time", F.explode("__times"))
    return near.where(matchup.within_hours(F.col("date_time"), F.col(scene_time), hours))


def _timed(insitu: DataFrame, wavelengths: Sequence[float]) -> DataFrame:
    """(uuid, __times, rho_w): in-situ spectra at the sensor's bands, once a point."""
    node = F.struct("wavelength", "rho")  # an instrument's bands: some hundred values a point
    spectra = insitu.groupBy("uuid").agg(F.collect_list(node).alias("n"), F.collect_set("date_time").alias("__times"))
    return spectra.select("uuid", "__times", spectral.resampled(F.col("n.wavelength"), F.col("n.rho"), wavelengths).alias("rho_w"))


def matchup_bands(pixels: DataFrame, wavelengths: Sequence[float], insitu: DataFrame, points: DataFrame, scene_time: str, hours: float = 12.0, land: bool = False, tile: int = 16) -> DataFrame:
    """matchups() of pixel rows whose bands are arrays, one row a pixel and band.

    pixels: row, col, x, y, image_name, the acquisition time, and arrays by band: rho_t and what with_atmosphere()
    adds (path, t_ra, s_ra, glint, t_gas). insitu (uuid, date_time, wavelength, rho) is brought to the sensor's bands
    once a point; windows and pixels meet in one join by tile; bands become rows after it, and what is left is plain
    arithmetic by row, which unlike functions of array elements is compiled.
    """
    near = _near(pixels, _timed(insitu, wavelengths), points, scene_time, hours, tile)
    bands = {"wavelength": F.array(*[F.lit(float(w)) for w in wavelengths])} | {c: F.col(c) for c in ("rho_w", "rho_t", "glint", "path", "t_ra", "s_ra", "t_gas")}
    return _carried(near.select("uuid", "image_name", "x", "y", F.inline(F.arrays_zip(*[v.alias(k) for k, v in bands.items()]))), land)


def matchup_means(pixels: DataFrame, wavelengths: Sequence[float], insitu: DataFrame, points: DataFrame, scene_time: str, hours: float = 12.0, land: bool = False, tile: int = 16) -> DataFrame:
    """(uuid, image_name, wl_idx, n, rho_t, rho_t_hat): matchup_bands() averaged over each point's window, without a row a pixel and point.

    A scene has no more windows than cells: each different one is summed once, band by band, its pixels told apart by the
    atmosphere's terms alone, since those and the point's own reflectance are all that rho_t_hat depends on. Points take
    their window's bands by an equi-join. Ids of several points are averaged over the rows of matchup_bands().
    """
    terms = ("glint", "path", "t_ra", "s_ra", "t_gas")
    again = matchup.repeated_ids(points)
    once = points if again is None else points.join(again, "uuid", "left_anti")
    p = pixels.select("row", "col", "image_name", F.col(scene_time).alias("__acq"), "rho_t", *terms)
    w = (*matchup.WINDOW, "image_name", "__acq")
    each = matchup.different_windows(p, once, tile).select(*w, F.posexplode(F.arrays_zip("rho_t", *terms)).alias("wl_idx", "b")).select(*w, "wl_idx", "b.*")
    alike = each.groupBy(*w, "wl_idx", *terms).agg(F.count("*").alias("m"), F.sum("rho_t").alias("s"), F.count("rho_t").alias("c"))
    bands = alike.groupBy(*w, "wl_idx").agg(F.sum("m").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("rho_t"), F.collect_list(F.struct("m", *terms)).alias("k"))  # at most a window's pixels
    packed = bands.groupBy(*w).agg(F.collect_list(F.struct("wl_idx", "n", "rho_t", "k")).alias("b"))  # a sensor's bands
    timed = _timed(insitu, wavelengths)
    near = matchup.by_window(once.select("uuid", *matchup.WINDOW).join(timed, "uuid")).join(packed, list(matchup.WINDOW))
    times = F.size(F.filter("__times", lambda t: matchup.within_hours(t, F.col("__acq"), hours)))
    rows = near.select("uuid", "image_name", "rho_w", times.alias("times"), F.inline("b")).where("times > 0")
    rows = rows.withColumn("rho_w", F.get("rho_w", F.col("wl_idx")))
    hat = lambda k: ph.surface_to_sensor(F.col("rho_w"), k["glint"], F.lit(land), k["t_gas"], k["path"], k["t_ra"], k["s_ra"])
    first = F.get("k", F.lit(0))
    known = F.filter(F.transform("k", lambda k: F.struct(k["m"].alias("m"), hat(k).alias("h"))), lambda x: x["h"].isNotNull())
    total = F.aggregate(known, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("m")), lambda a, x: F.struct((a["s"] + x["m"] * x["h"]).alias("s"), (a["m"] + x["m"]).alias("m")))
    mean = F.when(F.size("k") == 1, hat(first)).otherwise(F.try_divide(total["s"], total["m"]))
    out = rows.select("uuid", "image_name", "wl_idx", (F.col("n") * F.col("times")).alias("n"), "rho_t", mean.alias("rho_t_hat"))
    if again is None:
        return out
    plain = matchup_bands(pixels, wavelengths, insitu, points.join(again, "uuid", "left_semi"), scene_time, hours, land, tile)
    place = F.array_position(F.array(*[F.lit(float(x)) for x in wavelengths]), F.col("wavelength")).cast("int") - 1
    return out.unionByName(plain.groupBy("uuid", "image_name", place.alias("wl_idx")).agg(F.count("*").alias("n"), F.avg("rho_t").alias("rho_t"), F.avg("rho_t_hat").alias("rho_t_hat")))


# --- many scenes -----------------------------------------------------------------------


def archive_atmosphere(pixels: DataFrame, scenes: DataFrame, aerosol: DataFrame | Mapping[str, DataFrame], aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, key: str = "image_id", carry: Sequence[str] = ()) -> DataFrame:
    """with_atmosphere() for the pixels of all scenes in one plan; ``carry``: columns of ``scenes`` that pixels get too.

    Each scene's tables are bound to its own scalars (``scenes``: key and a column for every axis that does not vary
    by pixel) and packed into one row. The rows are counted: up to lut.TABLE_BYTES in all they are sent to every task,
    and no pixel is shuffled; beyond it pixels and rows meet by a join on the key. Pixels of a scene that is not in
    ``scenes``, or has a value outside an axis, get NULL terms. With several aerosol tables, by name, a scene takes
    the one that its ``aerosol_model`` names.
    """
    rows = scenes.select(key, *carry)
    n_bytes = 0
    for k, (nodes, spec) in enumerate(((aerosol, aerosol_spec), (gas, gas_spec))):
        packed, left = _bound(nodes, spec, scenes, key)
        rows = rows.join(packed.withColumnRenamed("table", f"__table{k}"), key, "left")
        n_bytes += len(spec.outputs) * 8 * math.prod(len(v) for v in left.axes.values())
    rows = materialize(rows, "scene-tables")
    n, bands = rows.agg(F.count("*"), F.max(F.size(F.get("__table0", F.lit(0))[aerosol_spec.outputs[0]]))).first()
    small = n * n_bytes * max(bands or 0, 1) <= lut.TABLE_BYTES
    out = pixels.join(F.broadcast(rows) if small else rows, key, "left")
    for k, spec in enumerate((aerosol_spec, gas_spec)):
        out = lut.interpolated(out, lut.LutSpec({a: v for a, v in spec.axes.items() if a in lut.PIXEL_AXES}, spec.outputs), f"__table{k}")
    return out


def _bound(nodes: DataFrame | Mapping[str, DataFrame], spec: lut.LutSpec, scenes: DataFrame, key: str) -> tuple[DataFrame, lut.LutSpec]:
    axes = [a for a in spec.axes if a not in lut.PIXEL_AXES]
    if isinstance(nodes, DataFrame):
        return lut.bind_scenes(nodes, spec, scenes, key, axes)
    parts = [lut.bind_scenes(n, spec, scenes.where(F.col("aerosol_model") == name), key, axes) for name, n in nodes.items()]
    return functools.reduce(DataFrame.unionByName, [p for p, _ in parts]), parts[0][1]


def dark_aod(l1: DataFrame, scenes: DataFrame, aerosol: Mapping[str, DataFrame], spec: lut.LutSpec, key: str = "image_id", axis: str = "aot550") -> DataFrame:
    """(key, aot550, aerosol_model, spread, n_bands): each scene's aerosol from its own dark spectrum.

    Of every band the darkest pixel (the first on ties, by row and column) gives the reflectance and its angles; the
    AOD of a band is where a model's path reflectance equals it, NULL outside the table. A scene's AOD by a model is
    the median of its bands, and the model whose bands agree best (least spread, then name) is taken. Scenes without a
    band inside keep NULL. All scenes and models are one plan: a pixel's bands are reduced to minima in its own task.
    """
    names, aods = list(aerosol), [float(x) for x in spec.axes[axis]]
    place = F.struct("value", "row", "col", *lut.PIXEL_AXES)
    long = l1.select(key, "row", "col", *lut.PIXEL_AXES, F.posexplode("rho_at_sensor").alias("wl_idx", "value")).where("value is not null and not isnan(value)")
    dark = materialize(long.groupBy(key, "wl_idx").agg(F.min(place).alias("d")).select(key, "wl_idx", "d.value", *[f"d.{a}" for a in lut.PIXEL_AXES]), "dark")
    found = []
    for name in names:
        only = lut.LutSpec(spec.axes, ["path"], spec.units)
        fixed = [a for a in spec.axes if a not in (*lut.PIXEL_AXES, axis)]
        table, left = lut.bind_scenes(aerosol[name].select(*[f"i_{a}" for a in spec.axes], "wl_idx", "path"), only, scenes, key, fixed)
        nodes = dark.join(table, key).select("*", F.posexplode(F.array(*[F.lit(a) for a in aods])).alias("__k", axis))
        path = lut.interpolated(nodes, left, band=F.col("wl_idx")).select(key, "wl_idx", "value", "__k", "path")
        curve = path.groupBy(key, "wl_idx", "value").agg(F.array_sort(F.collect_list(F.struct("__k", "path"))).alias("c"))  # the axis' nodes
        at = lambda k: F.get("c", F.lit(k))["path"]
        each = [F.when((F.col("value") >= at(k)) & (F.col("value") <= at(k + 1)), x + (F.col("value") - at(k)) * F.try_divide(F.lit(y - x), at(k + 1) - at(k))) for k, (x, y) in enumerate(zip(aods, aods[1:]))]
        found.append(curve.select(key, F.lit(name).alias("aerosol_model"), F.array_min(F.array(*each)).alias("aod")))
    by_model = functools.reduce(DataFrame.unionByName, found).groupBy(key, "aerosol_model").agg(F.median("aod").alias(axis), F.stddev_pop("aod").alias("spread"), F.count("aod").alias("n_bands"))  # a sensor's bands
    best = by_model.where("n_bands > 0").groupBy(key).agg(F.min(F.struct("spread", "aerosol_model", axis, "n_bands")).alias("b"))
    return scenes.select(key).join(best, key, "left").select(key, f"b.{axis}", "b.aerosol_model", "b.spread", "b.n_bands")


def archive_dark_l1_to_l2(pixels: DataFrame, scenes: DataFrame, wavelengths: Sequence[float], aerosol: Mapping[str, DataFrame], aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, key: str = "image_id", f0: str = "f0", exact: bool = False) -> DataFrame:
    """archive_l1_to_l2() without a given AOD: pixels are read once for the dark spectra and once for the correction."""
    sun = scenes.select(key, f0)  # a row a scene
    l1 = l1r(pixels.join(sun, key), wavelengths, F.col(f0)).drop(f0)
    aod = materialize(dark_aod(l1, scenes, aerosol, aerosol_spec, key), "aod")
    known = scenes.drop("aot550", "aerosol_model").join(aod.select(key, "aot550", "aerosol_model"), key, "left")
    return archive_l1_to_l2(pixels, known, wavelengths, aerosol, aerosol_spec, gas, gas_spec, key, f0, exact=exact).join(aod.select(key, "aot550", "aerosol_model"), key, "left")


def archive_l1_to_l2(pixels: DataFrame, scenes: DataFrame, wavelengths: Sequence[float], aerosol: DataFrame | Mapping[str, DataFrame], aerosol_spec: lut.LutSpec, gas: DataFrame, gas_spec: lut.LutSpec, key: str = "image_id", f0: str = "f0", gain: Sequence[float] | None = None, offset: Sequence[float] | None = None, exact: bool = False) -> DataFrame:
    """l1_to_l2() of an archive: ``scenes`` holds each scene's key, scalars and irradiance by band (``f0``)."""
    out = archive_atmosphere(pixels, scenes, aerosol, aerosol_spec, gas, gas_spec, key, (f0,))
    return surface(l1r(out, wavelengths, F.col(f0), gain, offset).drop(f0), wavelengths, exact)

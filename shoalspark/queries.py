"""Driver queries over the shared tables, each with its SQL.

Stand-ins: ``embeddings`` is a cube of 64 bands (wavelength 400 + 6.25 i,
reflectance (v + 1) / 20, row and column from the id, label as segment),
``lineitem`` holds matchups, ``events`` in-situ points and series, ``orders``
and ``part`` scenes and axes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions import physics as ph
from .operators import calib, dark, imageseg, invert, lut, matchup, raster, segment, spectral

WL = [400 + 6.25 * i for i in range(64)]
GREEN, NIR, RED = (spectral.nearest_band(WL, w) for w in (550, 800, 665))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def r(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r(c) for c in cols})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.expr("cast(vec_id div 25 as int)").alias("row"), F.expr("cast(vec_id % 25 as int)").alias("col"),
        F.col("label").alias("seg_id"), F.transform("embedding", lambda v: (v.cast("double") + 1) / 20).alias("s"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.to_long(pixels(spark, sf_dir), "s", WL, ["vec_id", "row", "col", "seg_id"])


def matchups(spark: SparkSession, sf_dir: str, wavelength: str = "l_linenumber") -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uuid"), F.col("l_returnflag").alias("image_name"), F.col(wavelength).cast("double").alias("wavelength"),
        (F.col("l_quantity") / 100).alias("rho_t"), (F.col("l_extendedprice") / 1e5).alias("rho_t_hat"),
    )


PX = """px AS (SELECT vec_id, CAST(vec_id // 25 AS INTEGER) AS "row", CAST(vec_id % 25 AS INTEGER) AS col, label AS seg_id,
  list_transform(embedding, lambda v: (v::DOUBLE + 1) / 20) AS s FROM embeddings)"""
LG = PX + """, lg AS (SELECT vec_id, "row", col, seg_id, (generate_subscripts(s, 1) - 1)::INTEGER AS wl_idx,
  400 + 6.25 * (generate_subscripts(s, 1) - 1)::DOUBLE AS wavelength, unnest(s) AS value FROM px)"""
M = """m AS (SELECT l_orderkey AS uuid, l_returnflag AS image_name, l_linenumber::DOUBLE AS wavelength, l_quantity / 100 AS rho_t, l_extendedprice / 1e5 AS rho_t_hat FROM lineitem)"""
RT = "SELECT wavelength, median(rho_t_hat / rho_t) AS gain, stddev_pop(rho_t_hat / rho_t) AS gain_std, count(*) AS n FROM m WHERE rho_t <> 0 GROUP BY 1"
MO = "mo AS (SELECT wavelength, count(*) AS n, avg(rho_t) AS mx, avg(rho_t_hat) AS my, var_pop(rho_t) AS vx, var_pop(rho_t_hat) AS vy, covar_pop(rho_t, rho_t_hat) AS cxy FROM m GROUP BY 1 HAVING count(*) >= 2)"
OLS = "SELECT wavelength, cxy / nullif(vx, 0) AS a, my - cxy / nullif(vx, 0) * mx AS b, cxy * cxy / nullif(vx * vy, 0) AS r2, n FROM mo"
SMA = "SELECT wavelength, sign(cxy) * sqrt(vy / nullif(vx, 0)) AS a, my - sign(cxy) * sqrt(vy / nullif(vx, 0)) * mx AS b, cxy * cxy / nullif(vx * vy, 0) AS r2, n FROM mo"


#: Wavelengths of a sensor of many bands: a row a part.
PART = "b AS (SELECT p_partkey AS wl_idx, (400 + p_partkey * 7 % 400)::DOUBLE AS w, 1 + p_partkey % 5 AS depth FROM part)"


def part_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("wl_idx"), (400 + k * 7 % 400).cast("double").alias("w"), (1 + k % 5).alias("depth"))


def q6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


# --- calibration ------------------------------------------------------------------


@query(f"WITH {M}, x AS ({RT}) SELECT wavelength, {q6('gain', 'gain_std')}, n FROM x")
def calib_ratio_fit(spark, sf_dir):
    return rounded(calib.fit("ratio", matchups(spark, sf_dir)), "gain", "gain_std").select("wavelength", "gain", "gain_std", "n")


@query(f"WITH {M}, {MO}, x AS ({OLS}) SELECT wavelength, {q6('a', 'b', 'r2')}, n FROM x")
def calib_ols_fit(spark, sf_dir):
    return rounded(calib.fit("ols", matchups(spark, sf_dir)), "a", "b", "r2")


@query(f"WITH {M}, {MO}, x AS ({SMA}) SELECT wavelength, {q6('a', 'b', 'r2')}, n FROM x")
def calib_sma_fit(spark, sf_dir):
    return rounded(calib.fit("sma", matchups(spark, sf_dir)), "a", "b", "r2")


@query(f"WITH {M}, x AS (SELECT wavelength, avg(rho_t_hat - rho_t) AS bias, sqrt(avg((rho_t_hat - rho_t) ^ 2)) AS rmse, count(rho_t) AS n FROM m GROUP BY 1) SELECT wavelength, {q6('bias', 'rmse')}, n FROM x")
def calib_summary(spark, sf_dir):
    return rounded(calib.summary(matchups(spark, sf_dir)), "bias", "rmse")


@query(f"WITH {M}, x AS ({RT}), y AS (SELECT min(gain) AS gain_min, max(gain) AS gain_max FROM x) SELECT count(DISTINCT uuid) AS n_uuid, count(DISTINCT image_name) AS n_image, count(*) AS n_pixels, round(any_value(gain_min), 6) + 0.0 AS gain_min, round(any_value(gain_max), 6) + 0.0 AS gain_max FROM m, y")
def calib_metadata(spark, sf_dir):
    m = matchups(spark, sf_dir)
    return rounded(calib.metadata(m, calib.fit("ratio", m)), "gain_min", "gain_max")


@query(f"WITH {M}, {MO}, x AS ({SMA}), y AS (SELECT m.*, a * rho_t + b AS rho_cal FROM m JOIN x USING (wavelength)) SELECT uuid, image_name, wavelength, {q6('rho_cal')} FROM y")
def calib_apply_affine(spark, sf_dir):
    m = matchups(spark, sf_dir)
    return rounded(calib.apply(m, calib.fit("sma", m)), "rho_cal").select("uuid", "image_name", "wavelength", "rho_cal")


@query(f"WITH {M}, x AS ({RT}), y AS (SELECT wavelength, rho_t * gain AS rho_cal FROM m JOIN x USING (wavelength)), z AS (SELECT wavelength, sum(rho_cal) AS total, max(rho_cal) AS most FROM y GROUP BY 1) SELECT wavelength, round(total, 4) + 0.0 AS total, {q6('most')} FROM z")
def calib_apply_ratio(spark, sf_dir):
    m = matchups(spark, sf_dir)
    out = calib.apply(m, calib.fit("ratio", m)).groupBy("wavelength").agg(F.sum("rho_cal").alias("total"), F.max("rho_cal").alias("most"))
    return out.select("wavelength", (F.round("total", 4) + F.lit(0.0)).alias("total"), r("most").alias("most"))


@query(f"WITH {M} SELECT image_name, count(*) AS n FROM (SELECT * FROM m WHERE image_name = 'A' UNION ALL SELECT * FROM m WHERE image_name = 'R' UNION ALL SELECT * FROM m WHERE image_name = 'N') GROUP BY 1")
def matchup_concat(spark, sf_dir):
    m = matchups(spark, sf_dir)
    return calib.concat(*[m.where(F.col("image_name") == k) for k in "ARN"]).groupBy("image_name").agg(F.count("*").alias("n"))


@query(f"WITH {M}, {MO}, x AS ({OLS}), s AS (SELECT wavelength AS x0, a AS a0, b AS b0, lead(wavelength) OVER (ORDER BY wavelength) AS x1, lead(a) OVER (ORDER BY wavelength) AS a1, lead(b) OVER (ORDER BY wavelength) AS b1 FROM x), t AS (SELECT 0.5 + i * 0.4 AS wavelength FROM range(20) r(i)), y AS (SELECT t.wavelength, a0 + (t.wavelength - x0) * (a1 - a0) / (x1 - x0) AS a, b0 + (t.wavelength - x0) * (b1 - b0) / (x1 - x0) AS b FROM t LEFT JOIN s ON x1 IS NOT NULL AND t.wavelength >= x0 AND (t.wavelength < x1 OR (t.wavelength = x1 AND x1 = 7))) SELECT {q6('wavelength', 'a', 'b')} FROM y")
def calib_align(spark, sf_dir):
    t = spark.range(20).select((F.col("id") * F.lit(0.4) + 0.5).alias("wavelength"))
    return rounded(calib.align(calib.fit("ols", matchups(spark, sf_dir)), t), "wavelength", "a", "b")


@query("WITH g AS (SELECT floor(p_retailprice / 50)::INTEGER AS k, arg_min(p_size / 10.0, p_partkey) AS gain FROM part GROUP BY 1) SELECT p_partkey, round(gain, 6) + 0.0 AS gain FROM part JOIN g ON floor(p_retailprice / 50)::INTEGER = k")
def gain_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("wavelength", F.col("p_retailprice") / 50)
    gains = p.groupBy(F.floor("wavelength").alias("k")).agg(F.min_by(F.col("p_size") / 10, "p_partkey").alias("gain")).select(F.col("k").cast("double").alias("wavelength"), "gain")
    return calib.gain_lookup(p, gains).select("p_partkey", r("gain").alias("gain"))


# --- spectra ----------------------------------------------------------------------


@query(f"WITH {LG} SELECT vec_id, wl_idx, wavelength, {q6('value')} FROM lg")
def spectrum_long(spark, sf_dir):
    return rounded(bands(spark, sf_dir), "value").select("vec_id", "wl_idx", "wavelength", "value")


@query(f"WITH {LG} SELECT vec_id, count(*) AS n_bands, round(sum(value), 6) + 0.0 AS total FROM lg WHERE wavelength BETWEEN 450 AND 700 GROUP BY 1")
def wavelength_mask(spark, sf_dir):
    part = spectral.take_bands("s", spectral.mask_wavelength(WL, [700, 500, 450]))
    return pixels(spark, sf_dir).select("vec_id", F.size(part).cast("long").alias("n_bands"), r(F.aggregate(part, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {LG}, t AS (SELECT unnest([490.0, 550.0, 561.0, 665.0, 800.0]) AS target), x AS (SELECT DISTINCT wl_idx, wavelength FROM lg), n AS (SELECT target, arg_min(wl_idx, abs(wavelength - target) * 1000 + wl_idx / 1000.0) AS wl_idx FROM t, x GROUP BY 1) SELECT vec_id, target, wl_idx, {q6('value')} FROM lg JOIN n USING (wl_idx)")
def nearest_band(spark, sf_dir):
    picks = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.lit(spectral.nearest_band(WL, t)).alias("wl_idx")) for t in (490, 550, 561, 665, 800)])
    return pixels(spark, sf_dir).select("vec_id", "s", F.inline(picks)).select("vec_id", "target", "wl_idx", r(F.get("s", F.col("wl_idx"))).alias("value"))


@query(f"WITH {PX} SELECT vec_id, len(s) = 64 AND s[61] IS NOT NULL AND list_bool_and(list_transform(s, lambda v: v >= 0)) AS valid FROM px")
def valid_mask(spark, sf_dir):
    return pixels(spark, sf_dir).select("vec_id", (F.get("s", F.lit(60)).isNotNull() & ph.valid("s", nonnegative=True) & (F.size("s") == 64)).alias("valid"))


@query(f"WITH {LG} SELECT vec_id, count(*) AS n_bands, round(sum(value), 6) + 0.0 AS total FROM lg WHERE wl_idx % 5 <> 0 GROUP BY 1")
def bad_band(spark, sf_dir):
    good = spectral.take_bands("s", spectral.good_bands([0 if i % 5 == 0 else 1 for i in range(64)]))
    return pixels(spark, sf_dir).select("vec_id", F.size(good).cast("long").alias("n_bands"), r(F.aggregate(good, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {PX} SELECT vec_id, round((s[{GREEN + 1}] - s[{NIR + 1}]) / nullif(s[{GREEN + 1}] + s[{NIR + 1}], 0), 6) + 0.0 AS ndwi, CASE WHEN (s[{GREEN + 1}] - s[{NIR + 1}]) / nullif(s[{GREEN + 1}] + s[{NIR + 1}], 0) > 0 THEN 1 ELSE 0 END::TINYINT AS mask_water FROM px")
def ndwi_mask(spark, sf_dir):
    n = ph.ndwi(F.get("s", F.lit(GREEN)), F.get("s", F.lit(NIR)))
    return pixels(spark, sf_dir).select("vec_id", r(n).alias("ndwi"), ph.water_mask(n).alias("mask_water"))


def _array_sql(expr: str) -> str:
    """A per-band expression of v (value) and w (wavelength), exploded."""
    return f"WITH {LG}, e AS (SELECT vec_id, wl_idx, value AS v, wavelength AS w, 20 + vec_id % 50 AS sza FROM lg) SELECT vec_id, wl_idx, round({expr}, 6) + 0.0 AS value FROM e"


def _exploded(df: DataFrame, spectrum: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(spectrum).alias("wl_idx", "value")).select("vec_id", "wl_idx", r("value").alias("value"))


def _sza() -> Column:
    return (20 + F.col("vec_id") % 50).cast("double")


@query(_array_sql("pi() * v / ((100 + w / 10) * cos(radians(sza)))"))
def toa_reflectance(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _exploded(p, ph.toa_reflectance("s", [100 + w / 10 for w in WL], _sza()))


@query(_array_sql("1.02 * (pi() * v / ((100 + w / 10) * cos(radians(sza)))) + 0.001"))
def toa_calibrated(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _exploded(p, ph.toa_reflectance("s", [100 + w / 10 for w in WL], _sza(), [1.02] * 64, [0.001] * 64))


def _terms() -> list[list[float]]:
    return [[0.9 + w / 10000 for w in WL], [0.02 - w / 100000 for w in WL], [0.8 + w / 10000 for w in WL], [0.2 - w / 10000 for w in WL]]


TERMS_SQL = {"g": "(0.9 + w / 10000)", "p": "(0.02 - w / 100000)", "t": "(0.8 + w / 10000)", "s": "(0.2 - w / 10000)"}


@query(_array_sql("(v / {g} - {p}) / {t} + {s} * (v / {g} - {p})".format(**TERMS_SQL)))
def atm_inverse(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(ph.atmosphere_inverse, F.col("s"), *_terms()))


@query(_array_sql("(v / {g} - {p}) / ({t} + {s} * (v / {g} - {p}))".format(**TERMS_SQL)))
def atm_inverse_exact(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(lambda *x: ph.atmosphere_inverse(*x, exact=True), F.col("s"), *_terms()))


@query(_array_sql("(v - {p} * {g} / (1 - {p} * {s})) / ({t} * {g} + {s} * (v - {p} * {g} / (1 - {p} * {s})))".format(**TERMS_SQL)))
def atm_inverse_legacy(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(ph.atmosphere_inverse_path_gas, F.col("s"), *_terms()))


@query(_array_sql("{g} * ({p} + {t} * v / (1 - {s} * v))".format(**TERMS_SQL)))
def atm_forward(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(ph.atmosphere_forward, F.col("s"), *_terms()))


@query(_array_sql("v / pi() / (0.52 + 1.7 * v / pi())"))
def rrs_convert(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(lambda x: ph.rho_to_rrs0m(x), "s"))


@query(_array_sql("pi() * 0.52 * (v / 5) / (1 - 1.7 * (v / 5))"))
def rrs_to_rho(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(lambda x: ph.rrs0m_to_rho(x / 5), "s"))


@query(_array_sql("greatest(0.52 / pow(0.52 + 1.7 * v / pi(), 2) * 0.01 / pi(), 1e-8)"))
def rrs_sigma(spark, sf_dir):
    return _exploded(pixels(spark, sf_dir), ph.each(lambda x: ph.sigma_to_rrs0m(x, F.lit(0.01)), "s"))


N_SQL = "(1.31405 + (1.779e-4 - 1.05e-6 * 12 + 1.6e-8 * 144) * 30 - 2.02e-6 * 144 + (15.868 + 0.01155 * 30 - 0.00423 * 12) / w - 4382 / (w * w) + 1.1455e6 / (w * w * w))"


@query(f"WITH {LG}, d AS (SELECT vec_id, wl_idx, value AS v, wavelength AS w FROM lg), e AS (SELECT *, pow((1 - {N_SQL}) / (1 + {N_SQL}), 2) AS f FROM d), n AS (SELECT vec_id, v AS vn, f AS fn FROM e WHERE wl_idx = {NIR}) SELECT vec_id, wl_idx, round(v - f * vn / fn, 6) + 0.0 AS value FROM e JOIN n USING (vec_id)")
def g21(spark, sf_dir):
    from .plans.correction import _index

    fresnel = [((1 - _index(w)) / (1 + _index(w))) ** 2 for w in WL]
    return _exploded(pixels(spark, sf_dir), ph.glint_from_nir("s", fresnel, NIR))


@query(f"WITH {PART} SELECT wl_idx, round({N_SQL}, 6) + 0.0 AS n, round(pow((1 - {N_SQL}) / (1 + {N_SQL}), 2), 6) + 0.0 AS nadir, round(0.00111 * pow(w / 500, -4.32), 9) + 0.0 AS bb_w FROM b")
def water_optics(spark, sf_dir):
    b = part_bands(spark, sf_dir)
    n = ph.water_index(F.col("w"))
    return b.select("wl_idx", r(n).alias("n"), r(ph.fresnel_nadir(n)).alias("nadir"), (F.round(ph.water_backscatter(F.col("w")), 9) + F.lit(0.0)).alias("bb_w"))


@query("WITH t AS (SELECT o_orderkey, 1 + (o_orderkey + o_custkey) % 85 AS theta FROM orders), b AS (SELECT *, radians(theta) AS a, asin(sin(radians(theta)) / 1.34) AS b FROM t) SELECT o_orderkey, theta, round(0.5 * (pow(sin(a - b) / sin(a + b), 2) + pow(tan(a - b) / tan(a + b), 2)), 6) + 0.0 AS fresnel FROM b")
def fresnel(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", (1 + (F.col("o_orderkey") + F.col("o_custkey")) % 85).alias("theta"))
    return t.select("o_orderkey", "theta", r(ph.fresnel(F.col("theta"), F.lit(1.34))).alias("fresnel"))


TAU = "(0.008569 * pow(w / 1000, -4) * (1 + 0.0113 * pow(w / 1000, -2) + 0.00013 * pow(w / 1000, -4)))"


@query(f"WITH {PART} SELECT wl_idx, round({TAU}, 6) + 0.0 AS tau, round(1000 / 1013.25 * {TAU}, 6) + 0.0 AS tau_1000, round(exp(-{TAU} / 2 * (1 / cos(radians(30)) + 1 / cos(radians(10)))), 6) + 0.0 AS t2 FROM b")
def rayleigh_tau(spark, sf_dir):
    b = part_bands(spark, sf_dir)
    t = ph.rayleigh_tau(F.col("w"))
    return b.select("wl_idx", r(t).alias("tau"), r(ph.rayleigh_tau(F.col("w"), 1000.0)).alias("tau_1000"), r(ph.rayleigh_transmittance(t, F.lit(30.0), F.lit(10.0))).alias("t2"))


@query("WITH s AS (SELECT 300 + (o_orderkey % 1200) * 0.5 AS wl, avg(o_totalprice) / 1e5 AS ssi FROM orders GROUP BY 1), b AS (SELECT p_partkey AS band, 400 + (p_partkey * 7 % 400) AS wavelength, 5.05 / (2 * sqrt(2 * ln(2))) AS sg FROM part) SELECT band, round(sum(ssi * exp(-0.5 * pow((wl - wavelength) / sg, 2))) / sum(exp(-0.5 * pow((wl - wavelength) / sg, 2))) * 100 * (1 + 0.034 * cos(2 * pi() * (200 - 2) / 365)), 6) + 0.0 AS f0 FROM b JOIN s ON abs(wl - wavelength) <= 4 * sg GROUP BY band")
def solar_f0_srf(spark, sf_dir):
    from .plans.correction import solar_f0

    s = read(spark, sf_dir, "orders").groupBy((300 + (F.col("o_orderkey") % 1200) * 0.5).alias("wl")).agg((F.avg("o_totalprice") / 1e5).alias("ssi"))
    b = part_bands(spark, sf_dir).select(F.col("wl_idx").alias("band"), F.col("w").alias("wavelength"), F.lit(5.05).alias("fwhm"))
    return solar_f0(b, s, 200).select("band", r("f0").alias("f0"))


@query(f"WITH {PX}, l AS (SELECT vec_id, s[{RED + 1}] * 15 AS x, s[{GREEN + 1}] * 15 AS y, s[15] * 15 AS z FROM px), g AS (SELECT vec_id, " + ", ".join(f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END AS {c}" for c in "xyz") + " FROM l), h AS (SELECT vec_id, (0.412453 * x + 0.357580 * y + 0.180423 * z) / 0.95047 AS x, 0.212671 * x + 0.715160 * y + 0.072169 * z AS y, (0.019334 * x + 0.119193 * y + 0.950227 * z) / 1.08883 AS z FROM g), k AS (SELECT vec_id, " + ", ".join(f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16.0 / 116 END AS {c}" for c in "xyz") + " FROM h) SELECT vec_id, round(116 * y - 16, 5) + 0.0 AS l, round(500 * (x - y), 5) + 0.0 AS a, round(200 * (y - z), 5) + 0.0 AS b FROM k")
def rgb_lab(spark, sf_dir):
    c = [F.get("s", F.lit(i)) * 15 for i in (RED, GREEN, 14)]
    return pixels(spark, sf_dir).select("vec_id", ph.rgb_to_lab(*c).alias("x")).select("vec_id", *[(F.round(f"x.{k}", 5) + F.lit(0.0)).alias(k) for k in "lab"])


@query(f"WITH {LG}, k AS (SELECT vec_id, wl_idx, CAST(round_even(value / 1e-4, 0) AS INTEGER) AS packed FROM lg) SELECT vec_id, wl_idx, packed, round(packed * 1e-4, 6) + 0.0 AS value FROM k")
def pack_unpack(spark, sf_dir):
    k = bands(spark, sf_dir).select("vec_id", "wl_idx", ph.pack(F.col("value"), 1e-4).alias("packed"))
    return k.select("vec_id", "wl_idx", "packed", r(ph.unpack(F.col("packed"), 1e-4)).alias("value"))


IOP = f"""WITH {PART},
c AS (SELECT *, 0.01 + greatest((0.5 + 0.02 * ln(0.06 * pow(2.0, 0.65))) * 0.06 * pow(2.0, 0.65), 0) + 0.3 * exp(-0.017 * (w - 440)) + 0.0051 * 1.5 * exp(-0.006 * (w - 440)) AS a,
  0.00111 * pow(w / 500, -4.32) + 0.0047 * 1.5 * pow(w / 550, -0.65) AS bb, cos(asin(sin(radians(30)) / 1.34)) AS cs, cos(asin(sin(radians(10)) / 1.34)) AS cv FROM b),
d AS (SELECT *, bb / (a + bb) AS o, 1.0546 * (a + bb) / cs AS kd FROM c),
e AS (SELECT *, 0.0512 * (1 + 4.6659 * o - 7.8387 * o * o + 5.4571 * o * o * o) * (1 + 0.1098 / cs) * (1 + 0.4021 / cv) AS f, (a + bb) / cv * pow(1 + o, 3.5421) * (1 - 0.2786 / cs) AS kw, (a + bb) / cv * pow(1 + o, 2.2658) * (1 - 0.0577 / cs) AS kb FROM d)
SELECT wl_idx, depth, round(f * o * (1 - 1.1576 * exp(-depth * (kd + kw))) + 1.0389 * (0.2 / pi()) * exp(-depth * (kd + kb)), 6) + 0.0 AS rrs, round(f * o, 6) + 0.0 AS deep, 0.2 AS bottom FROM e"""


@query(IOP)
def am03_forward(spark, sf_dir):
    b = part_bands(spark, sf_dir)
    w, lit = F.col("w"), lambda x: F.lit(float(x))
    a = ph.absorption(w, lit(0.01), lit(0.5), lit(0.02), lit(2), lit(0.3), lit(1.5), lit(0.017), lit(0.0051), lit(0.006))
    bb = ph.backscatter(w, ph.water_backscatter(w), lit(1.5), lit(0.0047), lit(0.65))
    rrs = ph.am03_rrs(a, bb, lit(30), lit(10), F.col("depth"), lit(0.2))
    back = ph.am03_bottom(rrs, a, bb, lit(30), lit(10), F.col("depth"))
    return b.select("wl_idx", "depth", r(rrs).alias("rrs"), r(ph.am03_rrs(a, bb, lit(30), lit(10))).alias("deep"), F.round(back, 4).alias("bottom"))


# --- interpolation -----------------------------------------------------------------

NODES = "n AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM n), e AS (SELECT min(x) AS xa, max(x) AS xb FROM n), t AS (SELECT o_orderkey, o_totalprice / 8000 AS q FROM orders)"


def _nodes(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))


@query(f"WITH {NODES}, u AS (SELECT o_orderkey, q, least(greatest(q, xa), xb) AS c, xb FROM t, e) SELECT o_orderkey, round(y0 + (c - x0) * (y1 - y0) / (x1 - x0), 4) + 0.0 AS y FROM u LEFT JOIN s ON x1 IS NOT NULL AND c >= x0 AND (c < x1 OR (c = x1 AND x1 = xb))")
def interp1_flat(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 8000).alias("q"))
    out = spectral.interpolate(t, "q", _nodes(spark, sf_dir), "x", "y", "y", "flat", bin_width=5.0)
    return out.select("o_orderkey", (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query(f"WITH {NODES} SELECT o_orderkey, round(y0 + (q - x0) * (y1 - y0) / (x1 - x0), 4) + 0.0 AS y FROM t CROSS JOIN e LEFT JOIN s ON x1 IS NOT NULL AND q >= x0 AND (q < x1 OR (q = x1 AND x1 = xb))")
def interp1_nan(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 8000).alias("q"))
    out = spectral.interpolate(t, "q", _nodes(spark, sf_dir), "x", "y", "y", bin_width=5.0)
    return out.select("o_orderkey", (F.round("y", 4) + F.lit(0.0)).alias("y"))


PATHS = "p AS (SELECT wavelength, a AS aod, 0.005 + 0.1 * a + wavelength / 1e6 AS r FROM (SELECT DISTINCT wavelength FROM lg), (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.4]) AS a)), s AS (SELECT wavelength, aod AS a0, r AS r0, lead(aod) OVER w AS a1, lead(r) OVER w AS r1 FROM p WINDOW w AS (PARTITION BY wavelength ORDER BY r))"
DARK = "d AS (SELECT wavelength, quantile_cont(value, 0.01) AS rho_dark FROM lg GROUP BY 1)"


def _aod(spark, sf_dir):
    d = dark.dark_percentile(bands(spark, sf_dir))
    steps = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.05, 0.1, 0.2, 0.4)]))
    p = d.select("wavelength", steps.alias("aod")).withColumn("rho_path", 0.005 + 0.1 * F.col("aod") + F.col("wavelength") / 1e6)
    return dark.invert_aod(d, p)


@query(f"WITH {LG}, {DARK}, {PATHS} SELECT d.wavelength, round(rho_dark, 6) + 0.0 AS rho_dark, round(min(a0 + (rho_dark - r0) * (a1 - a0) / (r1 - r0)), 6) + 0.0 AS aod FROM d LEFT JOIN s ON s.wavelength = d.wavelength AND a1 IS NOT NULL AND rho_dark >= r0 AND rho_dark <= r1 GROUP BY d.wavelength, rho_dark")
def inverse_interp(spark, sf_dir):
    return rounded(_aod(spark, sf_dir), "rho_dark", "aod").select("wavelength", "rho_dark", "aod")


@query(f"WITH {LG}, {DARK}, {PATHS}, x AS (SELECT d.wavelength, min(a0 + (rho_dark - r0) * (a1 - a0) / (r1 - r0)) AS aod FROM d LEFT JOIN s ON s.wavelength = d.wavelength AND a1 IS NOT NULL AND rho_dark >= r0 AND rho_dark <= r1 GROUP BY d.wavelength) SELECT round(median(aod), 6) + 0.0 AS aod550, count(aod) AS n_bands FROM x")
def scene_aod(spark, sf_dir):
    return rounded(dark.scene_aod(_aod(spark, sf_dir)), "aod550")


# --- dark spectrum and stretch ---------------------------------------------------------


@query(f"WITH {LG} SELECT wavelength, round(min(value), 6) + 0.0 AS rho_dark FROM lg GROUP BY 1")
def dark_min(spark, sf_dir):
    return rounded(dark.dark_min(bands(spark, sf_dir).withColumn("pixel", F.col("vec_id"))), "rho_dark")


@query(f"WITH {LG}, {DARK} SELECT wavelength, {q6('rho_dark')} FROM d")
def dark_percentile(spark, sf_dir):
    return rounded(dark.dark_percentile(bands(spark, sf_dir)), "rho_dark")


@query(f"WITH {LG}, k AS (SELECT wavelength, value, row_number() OVER (PARTITION BY wavelength ORDER BY value) - 1 AS x FROM lg QUALIFY x <= 1000) SELECT wavelength, round(avg(value) - covar_pop(x, value) / nullif(var_pop(x), 0) * avg(x), 6) + 0.0 AS rho_dark, count(*) AS n FROM k GROUP BY 1")
def dark_ols_rank(spark, sf_dir):
    return rounded(dark.dark_ols(bands(spark, sf_dir)), "rho_dark")


@query(f"WITH {PX}, k AS (SELECT vec_id, s[{RED + 1}] AS v FROM px), l AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM k) SELECT vec_id, round((least(greatest(v, a), b) - a) / (b - a + 1e-12), 6) + 0.0 AS stretched FROM k, l")
def rgb_stretch(spark, sf_dir):
    v = pixels(spark, sf_dir).select("vec_id", F.get("s", F.lit(RED)).alias("v"))
    return dark.stretch(v, "v").select("vec_id", r("stretched").alias("stretched"))


# --- segments ---------------------------------------------------------------------------


@query(f"WITH {LG}, k AS (SELECT seg_id, wavelength, median(value) AS rho_med FROM lg WHERE seg_id <> 0 GROUP BY 1, 2) SELECT seg_id, wavelength, round(any_value(rho_med), 6) + 0.0 AS rho_med, round(median(abs(value - rho_med)), 6) + 0.0 AS rho_mad FROM lg JOIN k USING (seg_id, wavelength) GROUP BY 1, 2")
def segment_median_mad(spark, sf_dir):
    return rounded(segment.band_stats(bands(spark, sf_dir)), "rho_med", "rho_mad")


@query(f"WITH {PX} SELECT seg_id, count(*)::INTEGER AS n_pix, round(median(s[{GREEN + 1}]), 6) + 0.0 AS green_med, round(stddev_pop(s[{GREEN + 1}]), 6) + 0.0 AS green_sd FROM px WHERE seg_id <> 0 GROUP BY 1")
def segment_counts(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("green", F.get("s", F.lit(GREEN)))
    return rounded(segment.scalar_stats(p, ["green"], ["green"]), "green_med", "green_sd")


@query(f"WITH {PX}, k AS (SELECT seg_id, avg(s[{NIR + 1}]) AS nir FROM px WHERE seg_id > 4 GROUP BY 1) SELECT vec_id, seg_id, round(nir, 6) + 0.0 AS nir FROM px LEFT JOIN k USING (seg_id)")
def segment_join_left(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("nir", F.get("s", F.lit(NIR)))
    m = segment.mean_features(p.where("seg_id > 4"), ["nir"]).drop("n_pix")
    return p.drop("nir").join(m, "seg_id", "left").select("vec_id", "seg_id", r("nir").alias("nir"))


@query(f"WITH {PX}, k AS (SELECT seg_id, dense_rank() OVER (ORDER BY seg_id)::INTEGER AS new_id FROM (SELECT DISTINCT seg_id * 7 AS seg_id FROM px WHERE seg_id <> 0)) SELECT vec_id, coalesce(new_id, 0) AS new_id FROM px LEFT JOIN k ON px.seg_id * 7 = k.seg_id")
def relabel_dense(spark, sf_dir):
    return segment.relabel_dense(pixels(spark, sf_dir).withColumn("seg_id", F.col("seg_id") * 7)).select("vec_id", "new_id")


@query(f"""WITH {PX}, p AS (SELECT "row", col, seg_id FROM px WHERE seg_id <> 0) SELECT DISTINCT least(p.seg_id, q.seg_id) AS a, greatest(p.seg_id, q.seg_id) AS b FROM p JOIN p q ON p.seg_id <> q.seg_id AND ((p."row" = q."row" AND q.col = p.col + 1) OR (q."row" = p."row" + 1 AND p.col = q.col))""")
def adjacency4(spark, sf_dir):
    return segment.adjacency(pixels(spark, sf_dir))


@query(f"WITH {LG}, c AS (SELECT seg_id, wavelength, avg(value) AS m, stddev_pop(value) AS s FROM lg GROUP BY 1, 2) SELECT wavelength, round(avg(m), 6) + 0.0 AS mu, round(sqrt(greatest(avg(s * s + m * m) - avg(m) * avg(m), 1e-6)), 6) + 0.0 AS sd FROM c GROUP BY 1")
def mixture_prior(spark, sf_dir):
    lib = bands(spark, sf_dir).groupBy("seg_id", "wavelength").agg(F.avg("value").alias("r_b_mean"), F.stddev_pop("value").alias("r_b_sd"))
    return rounded(segment.mixture_prior(lib), "mu", "sd")


@query("WITH k AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1) SELECT min(c) AS least, median(c) AS median, max(c) AS most FROM k")
def segment_row_counts(spark, sf_dir):
    return segment.row_counts(read(spark, sf_dir, "events"), "user_id")


@query("WITH k AS (SELECT event_id, event_type, value, CASE WHEN value < lag(value) OVER (PARTITION BY event_type ORDER BY event_id) THEN 1 ELSE 0 END AS f FROM events) SELECT event_id, (sum(f) OVER (PARTITION BY event_type ORDER BY event_id) + 1)::BIGINT AS replicate FROM k")
def replicate_ids(spark, sf_dir):
    return segment.replicate_ids(read(spark, sf_dir, "events"), "event_id", "event_type", "value").select("event_id", "replicate")


@query(f"WITH {LG}, k AS (SELECT vec_id, wavelength, CASE WHEN wl_idx % 9 <> vec_id % 9 THEN value END AS v FROM lg), m AS (SELECT wavelength, median(v) AS m FROM k GROUP BY 1) SELECT vec_id, wavelength, round(coalesce(v, m), 6) + 0.0 AS value FROM k JOIN m USING (wavelength)")
def median_fill(spark, sf_dir):
    v = bands(spark, sf_dir).withColumn("value", F.when(F.col("wl_idx") % 9 != F.col("vec_id") % 9, F.col("value")))
    return segment.median_fill(v, "value").select("vec_id", "wavelength", r("value").alias("value"))


# --- matchups and rasters ---------------------------------------------------------------


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) < 12 * 3600000000")
def temporal_match(spark, sf_dir):
    return read(spark, sf_dir, "events").where(matchup.within_hours(F.col("ts"), F.expr("timestamp'2024-01-10 12:00:00'"), 12)).select("event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_points(spark, sf_dir):
    return matchup.dedupe(read(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT user_id AS uuid, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_per_uuid(spark, sf_dir):
    return matchup.last_per_uuid(read(spark, sf_dir, "events").select(F.col("user_id").alias("uuid"), "event_type", "event_id"), "event_id")


@query("SELECT event_id, date_trunc('hour', ts) AS low, date_trunc('hour', ts) + INTERVAL 1 HOUR AS high, round((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3.6e9, 6) + 0.0 AS weight FROM events")
def bracket_hours(spark, sf_dir):
    low, high, w = geo.bracket_hours(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", low.cast("timestamp_ntz").alias("low"), high.cast("timestamp_ntz").alias("high"), r(w).alias("weight"))


@query("WITH s AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), p AS (SELECT event_id, date_trunc('hour', ts) AS lo, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hi, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 3.6e9 AS w FROM events) SELECT event_id, round(CASE WHEN w = 0 THEN a.v ELSE a.v * (1 - w) + b.v * w END, 6) + 0.0 AS v FROM p LEFT JOIN s a ON a.h = lo LEFT JOIN s b ON b.h = hi")
def hourly_interp(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    series = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    return matchup.bracket(e.select("event_id", "ts"), "ts", series, "h", ["v"]).select("event_id", r("v").alias("v"))


#: Points over the whole scene, however many rows it has.
ROWS = "(SELECT (max(vec_id) // 25)::INTEGER AS nr FROM embeddings)"
POINTS = f"pt AS (SELECT event_id AS uuid, nr, least(greatest(round(value * (nr + 1) / 500 - 0.5)::INTEGER, 0), nr) AS r0, least(greatest(round(value / 20 - 0.5)::INTEGER, 0), 24) AS c0 FROM events, {ROWS})"


def scene_rows(spark, sf_dir) -> int:
    return pixels(spark, sf_dir).agg(F.max("row")).first()[0] + 1


def _points(spark, sf_dir, size: int = 7):
    n = scene_rows(spark, sf_dir)
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), (F.col("value") / 20).alias("x"), (F.col("value") * n / 500).alias("y"))
    return matchup.windows(e, "x", "y", (1, 0, 0, 0, 1, 0), n, 25, size)


@query(f"""WITH {PX}, {POINTS} SELECT uuid, count(*) AS n, round(avg(s[{GREEN + 1}]), 6) + 0.0 AS mean FROM pt JOIN px ON "row" BETWEEN greatest(r0 - 3, 0) AND least(r0 + 3, nr) AND col BETWEEN greatest(c0 - 3, 0) AND least(c0 + 3, 24) GROUP BY 1""")
def window_range_join(spark, sf_dir):
    p = pixels(spark, sf_dir).select("row", "col", F.get("s", F.lit(GREEN)).alias("v"))
    return matchup.window_join(p, _points(spark, sf_dir), tile=8).groupBy("uuid").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"))


@query(f"""WITH {PX}, {POINTS} SELECT uuid FROM pt SEMI JOIN (SELECT "row", col FROM px WHERE seg_id > 5) v ON r0 = v."row" AND c0 = v.col""")
def footprint_semi(spark, sf_dir):
    valid = pixels(spark, sf_dir).withColumn("valid", F.col("seg_id") > 5)
    return matchup.in_footprint(_points(spark, sf_dir), valid).select("uuid")


@query(f"WITH {POINTS} SELECT uuid, (greatest(c0 - 3, 0) * 2 + 100)::DOUBLE AS x_min, (least(c0 + 3, 24) * 2 + 102)::DOUBLE AS x_max, (200 - 2 * (least(r0 + 3, nr) + 1))::DOUBLE AS y_min, (200 - 2 * greatest(r0 - 3, 0))::DOUBLE AS y_max FROM pt")
def window_boxes(spark, sf_dir):
    out = matchup.window_boxes(_points(spark, sf_dir), (2.0, 0.0, 100.0, 0.0, -2.0, 200.0))
    return out.select("uuid", *[F.col(c).cast("double").alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query(f"""WITH {PX} SELECT vec_id FROM px WHERE col + 0.5 BETWEEN 3 AND 9 AND "row" + 0.5 BETWEEN 2 AND 12""")
def bbox_crop(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5})
    return matchup.crop(p, (9, 12, 3, 2)).select("vec_id")


@query(f"""WITH {PX} SELECT vec_id, "row" AS line_index FROM px WHERE "row" BETWEEN 5 AND 7""")
def line_extract(spark, sf_dir):
    return matchup.pixel_line(pixels(spark, sf_dir).withColumn("line_index", F.col("row")), 5, 2).select("vec_id", "line_index")


@query(f"""WITH {PX} SELECT vec_id, ("row" // 8)::INTEGER AS tile_y, (col // 8)::INTEGER AS tile_x FROM px""")
def tile_assign(spark, sf_dir):
    return raster.tile_assign(pixels(spark, sf_dir), 8).select("vec_id", "tile_y", "tile_x")


@query(f"""WITH {PX}, a AS (SELECT vec_id, "row", col, CASE WHEN vec_id % 3 = 0 THEN s[1] END AS v FROM px), b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY "row" ORDER BY col) AS w FROM a), c AS (SELECT *, last_value(w IGNORE NULLS) OVER (PARTITION BY col ORDER BY "row") AS x FROM b), d AS (SELECT *, first_value(x IGNORE NULLS) OVER (PARTITION BY "row" ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM c) SELECT vec_id, round(last_value(y IGNORE NULLS) OVER (PARTITION BY col ORDER BY "row"), 6) + 0.0 AS filled FROM d""")
def fill_na_2d(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("v", F.when(F.col("vec_id") % 3 == 0, F.get("s", F.lit(0))))
    return raster.fill_gaps(p, "v").select("vec_id", r("filled").alias("filled"))


def _gauss_sql() -> str:
    k = ", ".join(f"({o}, {w!r})" for o, w in raster.kernel(1.0))
    return f"""WITH {PX}, k(o, w) AS (VALUES {k}), a AS (SELECT vec_id, "row", col, CASE WHEN vec_id % 7 <> 0 THEN s[1] END AS v FROM px), g AS (SELECT a."row" + y.o AS "row", a.col + x.o AS col, sum(coalesce(v, 0) * x.w * y.w) AS v, sum(CASE WHEN v IS NULL THEN 0 ELSE x.w * y.w END) AS m FROM a, k x, k y GROUP BY 1, 2) SELECT a.vec_id, round(CASE WHEN m >= 1e-6 THEN g.v / (m + 1e-12) END, 6) + 0.0 AS smooth FROM a JOIN g USING ("row", col)"""


@query(_gauss_sql())
def nan_gaussian(spark, sf_dir):
    p = pixels(spark, sf_dir).select("vec_id", "row", "col", F.when(F.col("vec_id") % 7 != 0, F.get("s", F.lit(0))).alias("v"))
    return raster.gaussian(p, "v", 1.0).select("vec_id", r("smooth").alias("smooth"))


@query("SELECT o_orderkey % 100 AS \"row\", o_custkey % 10 AS col, max_by(round(o_totalprice, 2), o_orderkey) AS v FROM orders GROUP BY 1, 2")
def glu_scatter(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("row"), (F.col("o_custkey") % 10).alias("col"), F.col("o_orderkey").alias("line"), F.lit(0).alias("sample"), F.round("o_totalprice", 2).alias("v"))
    return raster.scatter_last(o, "v")


@query("SELECT l_orderkey % 100 AS \"row\", l_partkey % 10 AS col, min(round(l_quantity, 2)) AS v FROM lineitem GROUP BY 1, 2")
def raster_mosaic(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("row"), (F.col("l_partkey") % 10).alias("col"), F.round("l_quantity", 2).alias("v"), F.col("l_suppkey").alias("source"))
    return raster.mosaic(li, "v", "min")


@query(f"""WITH {PX}, t AS (SELECT event_id, 1 + value / 30 AS x, 1 + value / 40 AS y FROM events), u AS (SELECT event_id, x - 0.5 AS u, y - 0.5 AS v FROM t), q AS (SELECT event_id, floor(v)::INTEGER + i AS r, floor(u)::INTEGER + j AS c, (1 - abs(v - floor(v) - i)) * (1 - abs(u - floor(u) - j)) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)), z AS (SELECT event_id, sum(w * s[1]) AS value, sum(CASE WHEN s IS NOT NULL THEN w END) AS m FROM q LEFT JOIN px ON px."row" = r AND px.col = c WHERE w > 0 GROUP BY 1) SELECT event_id, round(CASE WHEN m > 1 - 1e-9 THEN value END, 6) + 0.0 AS value FROM z""")
def reproject_bilinear(spark, sf_dir):
    t = read(spark, sf_dir, "events").select("event_id", (1 + F.col("value") / 30).alias("x"), (1 + F.col("value") / 40).alias("y"))
    src = pixels(spark, sf_dir).select("row", "col", F.get("s", F.lit(0)).alias("value"))
    return raster.resample(t, src, "value", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).select("event_id", r("value").alias("value"))


# --- look-up tables -----------------------------------------------------------------------


def _spec() -> lut.LutSpec:
    return lut.LutSpec({"sun_zenith": [0, 20, 40, 60, 80], "view_zenith": [0, 10, 20, 30], "relative_azimuth": [0, 60, 120, 180], "aot550": [0, 0.1, 0.3], "pressure": [900, 1013, 1050]}, ["path"])


def _lut_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).select("vec_id", (F.col("vec_id") % 80 + 0.5).alias("sun_zenith"), (F.col("vec_id") % 29 + 0.25).alias("view_zenith"), (F.col("vec_id") % 179 + 0.75).alias("relative_azimuth"))


@query(f"SELECT vec_id, round(0.02 + sza * 0.0003 + vza * 0.0002 + raa * 0.0001 + 0.17 * 0.1 + 1000 * 0.00001, 6) + 0.0 AS path FROM (SELECT vec_id, vec_id % 80 + 0.5 AS sza, vec_id % 29 + 0.25 AS vza, vec_id % 179 + 0.75 AS raa FROM embeddings) WHERE sza <= 80")
def lut_8corner(spark, sf_dir):
    spec = _spec()
    value = 0.02 + F.col("sun_zenith") * 0.0003 + F.col("view_zenith") * 0.0002 + F.col("relative_azimuth") * 0.0001 + F.col("aot550") * 0.1 + F.col("pressure") * 0.00001
    nodes = spec.grid(spark).withColumn("path", value).drop(*spec.axes)
    bound, left = lut.bind(nodes, spec, {"aot550": 0.17, "pressure": 1000})
    return lut.lookup(_lut_pixels(spark, sf_dir), bound, left, ["vec_id"]).select("vec_id", r("path").alias("path"))


@query("WITH n(a, b, v) AS (SELECT i, j, sin(i) + cos(j) FROM range(5) x(i), range(4) y(j)), p AS (SELECT vec_id, (vec_id % 37) / 10.0 AS x, (vec_id % 29) / 10.0 AS y FROM embeddings), c AS (SELECT vec_id, floor(least(x, 3.999999999))::INTEGER AS i, floor(least(y, 2.999999999))::INTEGER AS j, x, y FROM p) SELECT vec_id, round(sum((1 - abs(x - a)) * (1 - abs(y - b)) * v), 6) + 0.0 AS v FROM c JOIN n ON a BETWEEN i AND i + 1 AND b BETWEEN j AND j + 1 GROUP BY 1")
def lut_bilinear(spark, sf_dir):
    spec = lut.LutSpec({"x": [0, 1, 2, 3, 4], "y": [0, 1, 2, 3]}, ["v"])
    nodes = spec.grid(spark).withColumn("v", F.sin("x") + F.cos("y")).drop("x", "y")
    p = pixels(spark, sf_dir).select("vec_id", ((F.col("vec_id") % 37) / 10).alias("x"), ((F.col("vec_id") % 29) / 10).alias("y"))
    return lut.lookup(p, nodes, spec, ["vec_id"]).select("vec_id", r("v").alias("v"))


# --- reshape ----------------------------------------------------------------------------------


@query(f"WITH {LG} SELECT vec_id, " + ", ".join(f"round(any_value(value) FILTER (wl_idx = {i}), 6) + 0.0 AS m_{400 + 6.25 * i:g}".replace(".", "_").replace("0_0", "0.0") for i in range(64)) + " FROM lg GROUP BY 1")
def pivot_spectra(spark, sf_dir):
    out = spectral.pivot_bands(bands(spark, sf_dir), ["vec_id"], WL)
    return rounded(out, *[c for c in out.columns if c != "vec_id"])


@query(f"WITH {PX} SELECT vec_id, unnest(list_transform(range(64), lambda i: 400.0 + 6 * i))::DOUBLE AS wavelength, round(unnest(s), 6) + 0.0 AS value FROM px")
def unpivot_bands(spark, sf_dir):
    wide = pixels(spark, sf_dir).select("vec_id", *[F.get("s", F.lit(i)).alias(f"rhos_{400 + 6 * i}") for i in range(64)])
    return rounded(spectral.unpivot_bands(wide, ["vec_id"]), "value")


@query(f"WITH {LG} SELECT vec_id, count(*)::INTEGER AS n, round(arg_min(value, wavelength), 6) + 0.0 AS first, round(arg_max(value, wavelength), 6) + 0.0 AS last FROM lg GROUP BY 1")
def cube_round_trip(spark, sf_dir):
    c = spectral.to_cube(bands(spark, sf_dir), ["vec_id"])
    return c.select("vec_id", F.size("spectrum").alias("n"), r(F.get("spectrum", F.lit(0))).alias("first"), r(F.element_at("spectrum", -1)).alias("last"))


# --- geometry and dates ----------------------------------------------------------------------


@query("SELECT o_orderkey, round(julian(o_orderdate) - 0.5, 5) AS jd, dayofyear(o_orderdate)::INTEGER AS doy, round(1 + 0.034 * cos(2 * pi() * (dayofyear(o_orderdate) - 2) / 365), 6) + 0.0 AS factor FROM orders")
def julian_day(spark, sf_dir):
    d = F.dayofyear("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(geo.julian_day(F.col("o_orderdate")), 5).alias("jd"), d.alias("doy"), r(ph.earth_sun_factor(d)).alias("factor"))


def _sun_sql() -> str:
    return """WITH a AS (SELECT event_id, ts, 40 + event_id % 20 AS lat, -70 + event_id % 40 AS lon, (julian(date_trunc('second', ts)) - 0.5 - 2451545.0) / 36525 AS t FROM events),
b AS (SELECT *, (280.46645 + 36000.76983 * t + 0.0003032 * t * t) - 360 * floor((280.46645 + 36000.76983 * t + 0.0003032 * t * t) / 360) AS l0, 357.52910 + 35999.05030 * t - 0.0001559 * t * t - 0.00000048 * t * t * t AS m, 0.016708617 - 0.000042037 * t - 0.0000001236 * t * t AS e, radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60) AS o FROM a),
c AS (SELECT *, radians(l0 + (1.914600 - 0.004817 * t - 0.000014 * t * t) * sin(radians(m)) + (0.019993 - 0.000101 * t) * sin(radians(2 * m)) + 0.000290 * sin(radians(3 * m)) - 0.00569 - 0.00478 * sin(radians(125.04452 - 1934.136261 * t))) AS la, pow(tan(o / 2), 2) AS y FROM b),
d AS (SELECT *, asin(sin(o) * sin(la)) AS de, 4 * degrees(y * sin(radians(2 * l0)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(radians(2 * l0)) - 0.5 * y * y * sin(radians(4 * l0)) - 1.25 * e * e * sin(radians(2 * m))) AS eq FROM c),
f AS (SELECT *, hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0 + eq + 4 * lon AS u FROM d), g AS (SELECT *, (u - 1440 * floor(u / 1440)) / 4 - 180 AS h FROM f),
k AS (SELECT *, acos(sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(h))) AS z FROM g)
SELECT event_id, round(degrees(z), 4) + 0.0 AS zenith, round(CASE WHEN h > 0 THEN (degrees(acos((sin(radians(lat)) * cos(z) - sin(de)) / (cos(radians(lat)) * sin(z)))) + 180) ELSE 540 - degrees(acos((sin(radians(lat)) * cos(z) - sin(de)) / (cos(radians(lat)) * sin(z)))) END % 360, 3) + 0.0 AS azimuth FROM k"""


@query(_sun_sql())
def solar_geometry(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    e = e.select("event_id", "ts", (40 + F.col("event_id") % 20).cast("double").alias("lat"), (-70 + F.col("event_id") % 40).cast("double").alias("lon"))
    e = geo.with_sun_position(e, "ts", "lat", "lon")
    return e.select("event_id", (F.round("sun_zenith", 4) + F.lit(0.0)).alias("zenith"), (F.round("sun_azimuth", 3) + F.lit(0.0)).alias("azimuth"))


@query("SELECT event_id, round(degrees(atan(abs(250 - (event_id % 500 + 0.5)) / 1000)), 6) + 0.0 AS vza, CASE WHEN event_id % 500 < 250 THEN 125.0 ELSE 305.0 END::DOUBLE AS vaa FROM events")
def view_geometry(spark, sf_dir):
    z, a = geo.view_angles(F.col("event_id") % 500, 500, 1.0, 1000.0, 35.0)
    return read(spark, sf_dir, "events").select("event_id", r(z).alias("vza"), a.cast("double").alias("vaa"))


@query("SELECT event_id, round(sqrt(u * u + v * v), 6) + 0.0 AS speed, round(degrees(atan2(u, v)), 6) + 0.0 AS direction FROM (SELECT event_id, value - 100 AS u, 150 - value / 2 AS v FROM events)")
def wind(spark, sf_dir):
    u, v = F.col("value") - 100, 150 - F.col("value") / 2
    return read(spark, sf_dir, "events").select("event_id", r(ph.wind_speed(u, v)).alias("speed"), r(ph.wind_direction(u, v)).alias("direction"))


@query("SELECT o_orderkey, abs(a - b) AS raa, CASE WHEN abs(a - b) > 180 THEN 360 - abs(a - b) ELSE abs(a - b) END AS folded FROM (SELECT o_orderkey, (o_orderkey % 360)::DOUBLE AS a, (o_custkey % 360)::DOUBLE AS b FROM orders)")
def relative_azimuth(spark, sf_dir):
    a, b = (F.col("o_orderkey") % 360).cast("double"), (F.col("o_custkey") % 360).cast("double")
    return read(spark, sf_dir, "orders").select("o_orderkey", geo.relative_azimuth(a, b).alias("raa"), geo.relative_azimuth(a, b, True).alias("folded"))


# --- Python tier: rows only -----------------------------------------------------------------------


def _features(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", *[F.get("s", F.lit(i)).alias(f"f{k}") for k, i in enumerate((RED, GREEN, 14))])


@query()
def felzenszwalb(spark, sf_dir):
    return imageseg.segment(_features(spark, sf_dir), ["f0", "f1", "f2"], seams=True, scale=0.5, min_size=5)


@query()
def slic_merge(spark, sf_dir):
    f = _features(spark, sf_dir)
    labels = imageseg.segment(f, ["f0", "f1", "f2"], "slic", area=25)
    return segment.merge_by_distance(f.join(labels, ["row", "col"]), ["f0", "f1", "f2"], 0.2).select("row", "col", "seg_id", "merged_id")


@query()
def pca_features(spark, sf_dir):
    return imageseg.pca_features(pixels(spark, sf_dir), "s", ["vec_id"], 6)


@query()
def map_invert(spark, sf_dir):
    p = pixels(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).select("vec_id", F.col("s").alias("rho"), F.lit(30.0).alias("sun_zenith"), F.lit(5.0).alias("view_zenith"))
    return invert.invert(p, ["vec_id"], "rho", invert.synthetic_optics(WL), iterations=400, own_error=True)

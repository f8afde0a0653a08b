"""Operators on small tables with known answers."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.operators import calib, dark, imageseg, invert, lut, matchup, raster, segment, spectral
from shoalspark.plans import correction
from shoalspark.sources import envi, scene

MATCHUP = "uuid string, image_name string, wavelength double, rho_t double, rho_t_hat double"


def line(n=20, a=1.2, b=0.01):
    return [(f"u{i % 3}", f"i{i % 2}", w, 0.01 * i, a * 0.01 * i + b) for w in (400.0, 500.0) for i in range(1, n + 1)]


def test_fits_on_an_exact_line(spark):
    m = spark.createDataFrame([*line(), ("u9", "i9", 500.0, None, 1.0), ("u9", "i9", 500.0, float("nan"), 1.0), ("u9", "i9", 600.0, 0.1, 0.2)], MATCHUP)
    for name in ("ols", "sma"):
        got = {r["wavelength"]: r for r in calib.fit(name, m).collect()}
        assert set(got) == {400.0, 500.0}  # one row is not enough
        assert got[400.0]["a"] == pytest.approx(1.2) and got[400.0]["b"] == pytest.approx(0.01) and got[400.0]["r2"] == pytest.approx(1) and got[500.0]["n"] == 20
    ratios = [(1.2 * 0.01 * i + 0.01) / (0.01 * i) for i in range(1, 21)]
    r = {x["wavelength"]: x for x in calib.fit("ratio", m).collect()}
    assert r[400.0]["gain"] == pytest.approx(statistics.median(ratios)) and r[400.0]["gain_std"] == pytest.approx(statistics.pstdev(ratios)) and r[600.0]["n"] == 1


def test_constant_groups_and_unknown_model(spark):
    m = spark.createDataFrame([("u", "i", 400.0, 0.1, 0.2), ("u", "i", 400.0, 0.1, 0.3)], MATCHUP)
    r = calib.fit("ols", m).first()
    assert r["a"] is None and r["r2"] is None
    with pytest.raises(ValueError):
        calib.fit("nothing", m)


def test_calibration_apply_align_and_files(spark, tmp_path):
    m = spark.createDataFrame(line(), MATCHUP)
    c = calib.fit("sma", m)
    assert calib.apply(m, c).agg(F.max(F.abs(F.col("rho_cal") - F.col("rho_t_hat")))).first()[0] < 1e-12
    w = spark.createDataFrame([(350.0,), (400.0,), (450.0,), (500.0,), (501.0,)], "wavelength double")
    got = {r[0]: r[1] for r in calib.align(c, w).select("wavelength", "a").collect()}
    assert got[350.0] is None and got[501.0] is None and got[450.0] == pytest.approx(1.2) and got[500.0] == pytest.approx(1.2)
    path = str(tmp_path / "m.csv")
    calib.save(c, path, "sma", {"n": 2})
    name, meta, back = calib.load(spark, path)
    assert (name, meta) == ("sma", {"n": 2}) and back.count() == 2 and back.agg(F.max("a")).first()[0] == pytest.approx(1.2)
    bare = tmp_path / "g.csv"
    bare.write_text("wavelength,gain\n400,1.0\n")
    assert calib.load(spark, str(bare))[0] == "ratio"
    with pytest.raises(Exception, match="no gain"):
        calib.gain_lookup(w, spark.createDataFrame([(400.2, 1.0), (400.7, 2.0)], "wavelength double, gain double")).collect()


def test_summary_and_metadata(spark):
    m = spark.createDataFrame(line(), MATCHUP)
    s = {r["wavelength"]: r for r in calib.summary(m).collect()}
    d = [0.2 * 0.01 * i + 0.01 for i in range(1, 21)]
    assert s[400.0]["bias"] == pytest.approx(statistics.mean(d)) and s[400.0]["rmse"] == pytest.approx(math.sqrt(statistics.mean(x * x for x in d)))
    assert tuple(calib.metadata(m, calib.fit("sma", m)).first())[:3] == (3, 2, 40)


@pytest.mark.parametrize("q", [0.0, 0.01, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.gauss(0, 1), 3.0, rng.random() * 1e6])) for k in (1, 2) for _ in range(301)] + [(3, 5.0), (1, None), (2, float("nan"))]
    got = {r[0]: r[1] for r in spectral.exact_quantile(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", q).collect()}
    for k in (1, 2, 3):
        v = [x for a, x in rows if a == k and x is not None and not math.isnan(x)]
        assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_interpolation(spark):
    nodes = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (4.0, 0.0)], "x double, y double")
    q = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (4.0,), (5.0,)], "q double")
    for bins in (None, 0.7):
        got = {r["q"]: r["o"] for r in spectral.interpolate(q, "q", nodes, "x", "y", "o", bin_width=bins).collect()}
        assert got == {0.0: None, 1.0: 10.0, 1.5: 15.0, 2.0: 20.0, 3.0: 10.0, 4.0: 0.0, 5.0: None}
        flat = {r["q"]: r["o"] for r in spectral.interpolate(q, "q", nodes, "x", "y", "o", "flat", bin_width=bins).collect()}
        assert flat[0.0] == 10.0 and flat[5.0] == 0.0 and flat[1.5] == 15.0
    assert spark.range(1).select(spectral.literal_interp(F.lit(1.5), [1, 2], [10, 20])).first()[0] == 15
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(spectral.literal_interp(F.lit(9.5), [1, 2], [10, 20], "error")).collect()


def test_bands(spark):
    assert spectral.nearest_band([500, 510, 520], 515) == 1 and spectral.mask_wavelength([1, 2, 3, 4], [3, 2.5, 2]) == [1, 2]
    assert spectral.good_bands([0, 1, 0, 1]) == [1, 3] and spectral.good_bands([0, 1, 0, 1], contiguous=True) == [1, 2, 3]
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "id int, s array<double>")
    long = spectral.to_long(df, "s", [400, 500, 600], ["id"])
    assert spectral.to_cube(long, ["id"]).first()["spectrum"] == [0.1, 0.2, 0.3]
    assert spectral.pivot_bands(long, ["id"], [400, 600]).first().asDict() == {"id": 1, "m_400": 0.1, "m_600": 0.3}


def grid(spark, values):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "row int, col int, v double")


def table(df, col):
    rows = df.collect()
    out = [[None] * (max(r["col"] for r in rows) + 1) for _ in range(max(r["row"] for r in rows) + 1)]
    for r in rows:
        out[r["row"]][r["col"]] = r[col]
    return out


def test_rasters(spark):
    g = grid(spark, [[None, 1, None], [None, None, 2], [3, None, None]])
    assert table(raster.fill_gaps(g, "v"), "filled") == [[1, 1, 1], [1, 1, 2], [3, 3, 3]]
    flat = grid(spark, [[5] * 6] * 5)
    assert all(x == pytest.approx(5) for row in table(raster.gaussian(flat, "v", 1.0), "smooth") for x in row)
    assert all(x == pytest.approx(0.1, rel=1e-3) for row in table(raster.local_sigma(flat, "v", 1.0), "sigma") for x in row)
    near = table(raster.fill_nearby(grid(spark, [[1, None, 3]]), "v", 1), "filled")
    assert near == [[1, 2, 3]]
    assert raster.tile_union((0, 2, 5, 7), (1, 9, 3, 4)) == (0, 9, 3, 7) and raster.tile_grow((2, 3, 2, 3), 1) == (1, 4, 1, 4)
    src = grid(spark, [[0, 1, 2], [10, 11, 12], [20, 21, 22]])
    t = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.25, 1.5), (2, 9.0, 9.0)], "id int, x double, y double")
    assert {r["id"]: r["v"] for r in raster.resample(t, src, "v", (1, 0, 0, 0, 1, 0)).collect()} == {0: pytest.approx(5.5), 1: pytest.approx(11.75), 2: None}
    placed = src.withColumns({"x": F.col("col") * 2.0 + 1, "y": 50 - F.col("row") * 2.0})
    gt = raster.geotransform(placed).first()
    assert (gt["dx"], gt["dy"], gt["x_min"], gt["y_max"], gt["y_down"]) == (2.0, 2.0, 1.0, 50.0, True)
    m = spark.createDataFrame([(0, 0, 2.0, 2), (0, 0, 1.0, 1), (0, 1, None, 1)], "row int, col int, v double, source int")
    assert raster.mosaic(m, "v").first()["v"] == 1.0 and raster.mosaic(m, "v", "max").first()["v"] == 2.0


def test_segments(spark):
    p = spark.createDataFrame([(0, 0, 5, 1.0), (0, 1, 5, 3.0), (1, 0, 9, 1.1), (1, 1, 0, 7.0), (2, 2, 12, 1.0)], "row int, col int, seg_id long, f double").withColumn("wavelength", F.lit(400.0)).withColumn("value", F.col("f"))
    stats = {r["seg_id"]: (r["rho_med"], r["rho_mad"]) for r in segment.band_stats(p).collect()}
    assert stats == {5: (2.0, 1.0), 9: (1.1, 0.0), 12: (1.0, 0.0)}
    assert {(r["a"], r["b"]) for r in segment.adjacency(p).collect()} == {(5, 9)}
    assert {r["seg_id"]: r["new_id"] for r in segment.relabel_dense(p).collect()} == {5: 1, 9: 2, 12: 3, 0: 0}
    merged = {r["seg_id"] for r in segment.merge_by_distance(p, ["f"], 0.5).collect()}
    assert merged == {5, 12, 0}  # 9 touches 5 and is alike
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node long")
    roots = {r["node"]: r["root"] for r in segment.connected(chain, nodes).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == 100 and roots[200] == 200
    poly = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 6, "b")], "seg_id int, part int, n_pix int, name string")
    assert tuple(segment.dissolve(poly).first()) == (1, 11, "a")
    rep = spark.createDataFrame([("s", i, w) for i, w in enumerate([1, 2, 1, 2, 3, 0])], "class string, i int, wavelength int")
    assert [r["replicate"] for r in segment.replicate_ids(rep, "i").orderBy("i").collect()] == [1, 1, 2, 2, 2, 3]
    lib = spark.createDataFrame([(400.0, 0.1, 0.0), (400.0, 0.3, 0.0)], "wavelength double, r_b_mean double, r_b_sd double")
    assert tuple(segment.mixture_prior(lib).first()) == (400.0, pytest.approx(0.2), pytest.approx(0.1))


def test_dark(spark):
    rows = [(400.0, p, 0.01 + 0.001 * p, float(p)) for p in range(101)]
    long = spark.createDataFrame(rows, "wavelength double, pixel int, value double, sun_zenith double")
    assert dark.dark_min(long, ("sun_zenith",)).first()["sun_zenith"] == 0
    q = dark.dark_percentile(long, geometry=("sun_zenith",)).first()
    assert q["rho_dark"] == pytest.approx(0.011)
    assert dark.dark_ols(long, 50).first()["rho_dark"] == pytest.approx(0.01)
    path = spark.createDataFrame([(400.0, a, 0.005 + 0.05 * a) for a in (0.0, 0.1, 0.2)], "wavelength double, aod double, rho_path double")
    inv = dark.invert_aod(dark.dark_ols(long, 50), path)
    assert inv.first()["aod"] == pytest.approx(0.1) and dark.scene_aod(inv).first()["aod550"] == pytest.approx(0.1)


def test_matchups(spark):
    pts = spark.createDataFrame([("a", 5.2, 5.4), ("far", 900.0, -9.0)], "uuid string, x double, y double")
    w = {r["uuid"]: r for r in matchup.windows(pts, "x", "y", (1, 0, 0, 0, 1, 0), 10, 10, 3).collect()}
    assert (w["a"]["row"], w["a"]["col"], w["a"]["row0"], w["a"]["row1"]) == (5, 5, 4, 6) and (w["far"]["row1"], w["far"]["col0"], w["far"]["col1"]) == (1, 8, 9)
    px = spark.range(100).select(F.expr("int(id div 10)").alias("row"), F.expr("int(id % 10)").alias("col"))
    for tile in (1, 3, 64):
        assert matchup.window_join(px, matchup.windows(pts, "x", "y", (1, 0, 0, 0, 1, 0), 10, 10, 3), tile).groupBy("uuid").count().where("uuid = 'a'").first()[1] == 9


def spec():
    return lut.LutSpec({"sun_zenith": [0, 30, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "aot550": [0, 0.2, 0.5], "pressure": [900, 1100]}, ["path", "t_ra", "s_ra", "glint"])


def test_bound_table_equals_the_full_one(spark):
    s = spec()
    nodes = lut.synthetic(spark, s, [400.0, 500.0])
    scene_ = {"aot550": 0.13, "pressure": 1013}
    rows = [(i, 10.0 * i, 3.0 * i, 25.0 * i) for i in range(8)]
    px = spark.createDataFrame(rows, "id int, sun_zenith double, view_zenith double, relative_azimuth double")
    bound, left = lut.bind(nodes, s, scene_)
    a = {(r["id"], r["wl_idx"]): r["path"] for r in lut.lookup(px, bound, left, ["id"]).collect()}
    full = px.withColumns({k: F.lit(float(v)) for k, v in scene_.items()})
    b = {(r["id"], r["wl_idx"]): r["path"] for r in lut.lookup(full, nodes, s, ["id"]).collect()}
    assert a.keys() == b.keys() and len({k for k, _ in a}) == 7  # the last is outside: no row
    assert all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    assert lut.sweep(nodes, s, {"sun_zenith": 10, "view_zenith": 5, "relative_azimuth": 90, "pressure": 1000}).count() == 6
    assert lut.nearest_nodes(nodes, s, {"aot550": 0.1}).select("i_aot550").distinct().first()[0] == 0


def test_l1_to_l2(spark):
    wl = [550.0, 800.0]
    s, g = spec(), lut.LutSpec({"sun_zenith": [0, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "water": [0, 5]}, ["t_gas"])
    px = spark.createDataFrame([(0, 0, 30.0, 5.0, 90.0, [6.0, 2.0]), (0, 1, 30.0, 5.0, 90.0, [2.0, 6.0]), (0, 2, 85.0, 5.0, 90.0, [6.0, 2.0])], "row int, col int, sun_zenith double, view_zenith double, relative_azimuth double, radiance array<double>")
    l1 = correction.l1r(px, wl, [100.0, 90.0])
    atm = correction.atmosphere(px, ["row", "col"], lut.synthetic(spark, s, wl), s, lut.synthetic(spark, g, wl), g, {"aot550": 0.1, "pressure": 1013, "water": 2})
    got = {r["col"]: r for r in correction.l2r(l1, atm, ["row", "col"], wl, exact=True).collect()}
    assert (got[0]["mask_water"], got[1]["mask_water"]) == (1, 0)
    assert len(got[0]["rho_w"]) == 2 and got[1]["rho_w"] is None and got[0]["rho_w_gl21"][1] == pytest.approx(0)
    assert got[2]["rho_s"] is None
    r = got[0]
    up = r["t_gas"][0] * (r["path"][0] + r["t_ra"][0] * r["rho_s"][0] / (1 - r["s_ra"][0] * r["rho_s"][0]))
    assert up == pytest.approx(r["rho_at_sensor"][0])


def test_matchup_plan(spark):
    px = spark.createDataFrame([(r, c, float(c), float(r), "img", w, 0.1, "2024-01-01 12:00:00") for r in range(5) for c in range(5) for w in (450.0, 550.0)], "row int, col int, x double, y double, image_name string, wavelength double, rho_t double, acq string").withColumn("acq", F.to_timestamp("acq"))
    pts = matchup.windows(spark.createDataFrame([("u", 2.5, 2.5), ("late", 2.5, 2.5)], "uuid string, px double, py double"), "px", "py", (1, 0, 0, 0, 1, 0), 5, 5, 3)
    ins = spark.createDataFrame([(u, t, w, w / 10000) for u, t in (("u", "2024-01-01 10:00:00"), ("late", "2024-01-03 10:00:00")) for w in (400.0, 500.0)], "uuid string, date_time string, wavelength double, rho double").withColumn("date_time", F.to_timestamp("date_time"))
    atm = px.select("row", "col", "wavelength", F.lit(0.02).alias("path"), F.lit(0.9).alias("t_ra"), F.lit(0.1).alias("s_ra"), F.lit(0.001).alias("glint"), F.lit(0.95).alias("t_gas"))
    out = correction.matchups(px, atm, ins, pts, "acq")
    rows = out.collect()
    assert len(rows) == 18 and {r["uuid"] for r in rows} == {"u"} and all(r["rho_t_hat"] > 0 for r in rows)
    assert {r["wavelength"]: round(r["rho_w"], 6) for r in rows} == {450.0: 0.045, 550.0: 0.05}
    assert calib.fit("ratio", out).count() == 2


def test_inversion(spark):
    wl = np.arange(420.0, 700.0, 20)
    o = invert.synthetic_optics(wl)
    truth = {"chl": 1.5, "ag440": 0.2, "spm": 1.0, "anap": 0.0051, "bbp": 0.0047, "s_g": 0.017, "s_nap": 0.006, "gamma": 0.65, "h_w": 4.0}
    rrs = invert.forward(truth, o, 30, 5)
    post = invert.Posterior(rrs, np.full(len(wl), 1e-4), o, 30, 5)
    u = np.full(9, 0.1)
    g = post.gradient(u)
    d = np.random.default_rng(1).standard_normal(9)
    assert g @ d == pytest.approx((post.value(u + 1e-6 * d) - post.value(u - 1e-6 * d)) / 2e-6, rel=1e-3)
    rho = (math.pi * 0.52 * rrs / (1 - 1.7 * rrs)).tolist()
    df = spark.createDataFrame([(1, rho, 30.0, 5.0), (2, None, 30.0, 5.0), (3, [-1.0] * len(wl), 30.0, 5.0)], "id int, rho array<double>, sun_zenith double, view_zenith double")
    got = {r["id"]: r for r in invert.invert(df, ["id"], "rho", o).collect()}
    assert got[1]["h_w"] == pytest.approx(4, abs=0.5) and got[2]["chl"] is None and not got[3]["ok"]
    quad = lambda x: 0.5 * float(((x - 3) ** 2).sum())
    draws = invert.sample(quad, lambda x: x - 3, np.zeros(2), 400, 200, 2)
    assert draws.mean(axis=0) == pytest.approx([3, 3], abs=0.3) and draws.std(axis=0) == pytest.approx([1, 1], abs=0.3)


def test_bottom_prior():
    rng = np.random.default_rng(2)
    reps = {k: np.clip(m + 0.02 * rng.standard_normal((30, 12)), 0.01, 0.9) for k, m in (("sand", 0.4), ("weed", 0.1))}
    p = invert.bottom_prior(reps, q=3)
    near, far = invert.bottom_log_density(p["mu"][0], p), invert.bottom_log_density(p["mu"][0] + 5, p)
    assert near > far and len(p["classes"]) == 2
    assert invert.covariance(np.ones((1, 3))).tolist() == [[0] * 3] * 3


def test_image_segmentation(spark):
    p = spark.createDataFrame([(r, c, 0.0 if c < 6 else 10.0) for r in range(12) for c in range(12)], "row int, col int, f double")
    for how, opts in (("graph", {"scale": 1.0, "min_size": 5}), ("slic", {"area": 36, "compactness": 0.01})):
        got = imageseg.segment(p, ["f"], how, **opts).collect()
        left, right = ({r["seg_id"] for r in got if (r["col"] < 6) == side} for side in (True, False))
        assert len(got) == 144 and not left & right
    assert imageseg.segment(p, ["f"], "graph", tile=6, scale=1.0, min_size=1).select("seg_id").distinct().count() == 4
    masked = imageseg.segment(p.withColumn("f", F.when(F.col("row") > 0, F.col("f"))), ["f"], scale=1.0, min_size=1)
    assert masked.where("row = 0").select("seg_id").distinct().first()[0] == 0


def test_sources(spark, tmp_path):
    hdr = tmp_path / "a.hdr"
    hdr.write_text("ENVI\nSamples = 4\nlines=2\nmap info = {UTM, 1, 1, 500000, 5500000, 2.5, 2.5, 20, North}\ndescription = {\n  Swath = 7 ,\n  unit = m }\nwavelength = {\n 400.0, 500.5 }\n")
    h = envi.read_header(spark, str(hdr))
    assert h["samples"] == "4" and h["wavelength"] == ["400.0", "500.5"] and h["swath"] == "7"
    affine, proj = envi.parse_map_info(h["map info"])
    assert affine == (2.5, 0.0, 500000.0, 0.0, -2.5, 5500000.0) and proj == "UTM zone 20 North"
    assert envi.parse_map_info("UTM, 2, 1, 0, 0, 1, 1") is None
    nav = tmp_path / "n.log"
    nav.write_text("junk\nAverage Value 1000.5 45.25\n")
    line = envi.read_flight_line(spark, str(nav), str(hdr))
    assert (line.height, line.heading, line.resolution) == (1000.5, 45.25, 2.5)
    csv = tmp_path / "i.csv"
    csv.write_text("UUID,Date_Time,LAT,lon,Wavelength,rho\nu,2024-01-01T10:00:00Z,49,-64,550,0.02\n")
    assert scene.read_insitu(spark, str(csv)).first()["rho"] == 0.02
    with pytest.raises(ValueError):
        scene.read_library(spark, str(csv), ["a_w"])
    cube = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    cube.tofile(tmp_path / "c.raw")
    spark.dataSource.register(scene.RawCube)
    df = spark.read.format("raw_cube").options(path=str(tmp_path / "c.raw"), samples=4, lines=3, bands=2, block=2).load()
    assert {(r["row"], r["col"]): list(r["radiance"]) for r in df.collect()}[(2, 1)] == [9.0, 21.0]
    assert scene.sql_safe("a[0].b-c (d)") == "a_0_b_c_d" and scene.decode_metadata([0.5, 1.5], [9.5, 8.5]) == (1.0, 0.0, 0.0, 0.0, -1.0, 10.0)


def test_scene_round_trip(spark, tmp_path):
    px = scene.place(spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "row int, col int"), (1, 0, 10, 0, -1, 20), 2).withColumn("image_id", F.lit("s"))
    sc = spark.createDataFrame([("s", [1.0, 0.0, 10.0, 0.0, -1.0, 20.0], None)], "image_id string, affine array<double>, ozone double")
    scene.write_scene(px, sc, str(tmp_path / "o"))
    assert scene.read_scene(spark, str(tmp_path / "o")).first()["geo_transform"] == "10.0 1.0 0.0 20.0 0.0 -1.0"
    one = scene.read_pixels(spark, str(tmp_path / "o"), (F.col("tile_y") == 1) & (F.col("tile_x") == 0))
    assert one.count() == 4 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()
    filled = scene.fill_scalars(sc, spark.createDataFrame([("s", 0.3)], "image_id string, ozone double"), ["ozone"])
    assert filled.first()["ozone"] == 0.3


def test_stream(spark, tmp_path):
    from shoalspark.streaming import landing

    spark.createDataFrame([(f"2024-01-01 10:{i:02d}:00", "a", float(i)) for i in range(10)] + [("2024-01-03 10:00:00", "a", 1.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = landing.hourly_points(landing.arriving(spark, str(tmp_path / "in"), "ts timestamp, k string, v double"), "ts", "k", "v")
    q = s.writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.table("hourly").collect()] == [("a", 4.5, 10)]


def test_inversion_models():
    """Derivatives of every model as differences, and the water found again under a mixture of bottoms."""
    rng = np.random.default_rng(3)
    wl = np.linspace(400, 790, 40)
    o, n = invert.synthetic_optics(wl), 60
    reps = {k: np.clip(m + 0.05 * np.sin(wl / 60 + i) + 0.02 * rng.standard_normal((30, 40)), 0.01, 0.9) for i, (k, m) in enumerate((("sand", 0.4), ("weed", 0.1)))}
    prior = invert.bottom_prior(reps, 4)
    aod = np.array([0, 0.1, 0.3])
    sweep = invert.Sweep(aod, 0.02 + 0.1 * aod[:, None] + 0 * wl, 0.9 - 0.2 * aod[:, None] + 0 * wl, 0.05 + 0.1 * aod[:, None] + 0 * wl)
    sun, view = np.full(n, 30.0), np.full(n, 5.0)
    for more in ({}, {"prior": prior}, {"prior": invert.delta_prior(o.bottom, np.full(40, 0.02)), "sweep": sweep}):
        m = invert.Model(np.full((n, 40), 0.01), np.full((n, 40), 2e-4), o, sun, view, **more)
        x = m.start() + 0.1 * rng.standard_normal((n, m.size))
        d = rng.standard_normal(x.shape)
        for m.jacobian in (False, True):
            slope = (m.evaluate(x + 1e-6 * d)[0] - m.evaluate(x - 1e-6 * d)[0]) / 2e-6
            assert (m.evaluate(x)[1] * d).sum(axis=1) == pytest.approx(slope, rel=1e-5)
    truth = {k: np.exp(rng.normal(m, s, n)) for k, (m, s) in invert.LOG_PRIORS.items()} | {k: np.full(n, m) for k, (m, s) in invert.NORMAL_PRIORS.items()}
    truth["h_w"] = rng.uniform(1, 4, n)
    rb = reps["sand"][rng.integers(0, 30, n)]
    obs = invert.water(truth, o, sun, view, rb)[0] + 1e-4 * rng.standard_normal((n, 40))
    m = invert.Model(obs, np.full(obs.shape, 1e-4), o, sun, view, prior=prior)
    x, value, ok = invert.solve_stepwise(m, iterations=500)
    known = m.start()  # the vector of the truth
    known[:, m.n :] = np.log(rb / (1 - rb))
    for k, (mean, sd) in invert.LOG_PRIORS.items():
        known[:, m.names.index(k)] = (np.log(truth[k]) - mean) / sd
    depth = lambda v: np.log(v / (invert.MOST_DEPTH - v))
    known[:, m.names.index("h_w")] = (depth(truth["h_w"]) - depth(3.0)) * 3.0 * 0.9 / 2.0
    assert m.unpack(known)[0]["h_w"] == pytest.approx(truth["h_w"])
    assert ok.mean() > 0.9 and (value <= m.evaluate(known)[0])[ok].mean() > 0.9  # no worse than the truth
    _, _, few = invert.solve(m, iterations=2)
    assert not few.any()  # what has not settled is not ok
    z = invert.sample_all(invert.Model(obs, np.full(obs.shape, 2e-4), o, sun, view, jacobian=True), np.zeros((n, 9)), 40, 40, 1)
    assert np.isfinite(z).all()


def test_settled_only_is_ok_and_segments(spark):
    wl = [400 + 10.0 * i for i in range(12)]
    o = invert.synthetic_optics(wl)
    long = spark.createDataFrame([(s, w, 0.01 + 0.001 * s + 0.0001 * k) for s in (1, 2) for w in wl for k in range(5)] + [(3, 400.0, 0.1)], "seg_id int, wavelength double, value double")
    scalars = spark.createDataFrame([(s, 30.0, 5.0) for s in (1, 2, 3)], "seg_id int, sun_zenith double, view_zenith double")
    spectra = invert.segment_spectra(segment.band_stats(long), scalars, wl)
    assert {r["seg_id"]: round(r["sigma"][0], 8) for r in spectra.collect()} == {1: 0.00014826, 2: 0.00014826}
    got = invert.invert(spectra, ["seg_id"], "rho", o, sigma="sigma", prior=invert.delta_prior(o.bottom, np.full(12, 0.05)))
    raster_ = invert.to_raster(got, spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 0)], "row int, col int, seg_id int")).collect()
    assert len(raster_) == 3 and [r["chl"] is None for r in sorted(raster_, key=lambda r: (r["row"], r["col"]))] == [False, False, True]
    deep = invert.invert(spectra.withColumn("depth", F.lit(50.0)), ["seg_id"], "rho", o, sigma="sigma", most_depth=("depth", 20.0))
    assert not deep.where("ok").count()


def test_segments_cross_the_seams_of_tiles(spark):
    p = spark.createDataFrame([(r, c, 0.0 if c < 6 else 10.0) for r in range(12) for c in range(12)], "row int, col int, f double")
    whole = {(r["row"], r["col"]): r["seg_id"] for r in imageseg.segment(p, ["f"], scale=1.0, min_size=5).collect()}
    tiled = {(r["row"], r["col"]): r["seg_id"] for r in imageseg.segment(p, ["f"], tile=4, seams=True, scale=1.0, min_size=5).collect()}
    assert len({*zip(whole.values(), (tiled[k] for k in whole))}) == 2 and len(set(tiled.values())) == 2


def test_arrays_of_the_atmosphere_and_caches(spark, tmp_path):
    spec = lut.LutSpec({"x": [0, 1, 3], "y": [0, 2]}, ["p", "q"], {"x": "m", "y": "s"})
    nodes = spec.grid(spark).select("i_x", "i_y", F.posexplode(F.array(F.lit(400.0), F.lit(500.0))).alias("wl_idx", "wavelength"), "x", "y")
    nodes = nodes.select("i_x", "i_y", "wl_idx", "wavelength", (F.col("x") * F.col("x") + F.col("y") + F.col("wl_idx")).alias("p"), F.col("x").alias("q"))
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, 2.0), (3, 9.0, 1.0), (4, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: (r["p"], r["q"]) for r in lut.lookup_arrays(df, nodes, spec).collect()}
    assert got == {1: ([6.0, 7.0], [2.0, 2.0]), 2: ([11.0, 12.0], [3.0, 3.0]), 3: (None, None), 4: (None, None)}
    long = {(r["id"], r["wl_idx"]): r["p"] for r in lut.lookup(df, nodes, spec, ["id"]).collect()}
    assert all(long[i, k] == pytest.approx(got[i][0][k]) for i in (1, 2) for k in (0, 1))
    assert "Exchange" not in lut.lookup_arrays(df, nodes, spec)._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    lut.to_files(nodes, spec, str(tmp_path / "t"))
    stored, found = lut.from_files(spark, str(tmp_path / "t"))
    assert found == lut.LutSpec({"x": [0.0, 1.0, 3.0], "y": [0.0, 2.0]}, ["p", "q"], {"x": "m", "y": "s"}) and stored.count() == 12
    with pytest.raises(ValueError):
        lut.at_sensor(nodes, spec, spark.createDataFrame([(0, 399.0)], "wl_idx int, wavelength double"))
    assert lut.band_key([400.0, 500.0]) != lut.band_key([400.0, 501.0]) and len(lut.band_key([1.0])) == 12


def test_nothing_left_is_an_error(spark):
    px = grid(spark, [[1.0, 2.0], [3.0, 4.0]]).withColumn("valid", F.col("v") > 9)
    pts = spark.createDataFrame([("u", 0.5, 0.5, None)], "uuid string, x double, y double, date_time timestamp")
    with pytest.raises(ValueError):
        matchup.extract_pixels(px, pts, (1, 0, 0, 0, 1, 0), 2, 2)
    with pytest.raises(ValueError):
        matchup.crop_to_table(px.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5, "s": F.array("v")}), (50, 50, 60, 60), "s", [400.0], (300, 500))


def test_ancillary_and_registry(spark, tmp_path):
    from shoalspark.operators import ancillary
    from shoalspark.sources import registry

    assert ancillary.merged({"a": 1}, {"b": 2, "a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        ancillary.merged({"a": 1}, {"a": 2})
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert registry.fetch(spark, str(tmp_path), "x.bin", good).endswith("x.bin")
    with pytest.raises(ValueError):
        registry.fetch(spark, str(tmp_path), "x.bin", "0" * 64)


def test_chunked_arrays(spark, tmp_path):
    from shoalspark.sources import zarr

    px = spark.createDataFrame([(r, c, [float(r), None, float(r * 10 + c)]) for r in range(5) for c in range(7)], "row int, col int, s array<double>")
    path = str(tmp_path / "scene")
    zarr.write_scene(px, "s", [400.0, 500.0, 600.0], (2, 0, 10, 0, -2, 90), (5, 7), path, "rho", "WKT", tile=4, attrs={"level": "L1R"})
    got = {(r["wl_idx"], r["row"], r["col"]): r for r in zarr.open_scene(spark, path, "rho").collect()}
    assert len(got) == 3 * 35 and got[2, 4, 6]["value"] == 46.0 and got[1, 0, 0]["value"] is None
    assert (got[0, 4, 6]["x"], got[0, 4, 6]["y"], got[2, 0, 0]["wavelength"]) == (23.0, 81.0, 600.0)
    assert zarr.attributes(path, "spatial_ref")["GeoTransform"] == "10.0 2.0 0.0 90.0 0.0 -2.0" and zarr.attributes(path)["Conventions"] == "CF-1.8"
    with pytest.raises(FileNotFoundError):
        zarr.attributes(str(tmp_path / "none"))


def test_segment_export_and_checked_data(spark, tmp_path):
    from shoalspark.plans import segments

    p = spark.createDataFrame([(r, c, 0.0 if c < 6 else 10.0, [0.1, 0.2 + c / 100]) for r in range(12) for c in range(12)], "row int, col int, f double, s array<double>")
    segments.segment_and_export(p, ["f"], "s", [400.0, 500.0], str(tmp_path / "o"), ["f"], scale=1.0, min_size=5, tile=4)
    assert {(r["seg_id"], r["n_pix"], r["col0"], r["col1"]) for r in segments.read(spark, str(tmp_path / "o"), "segments").collect()} == {(1, 72, 0, 5), (2, 72, 6, 11)}
    assert segments.read(spark, str(tmp_path / "o"), "spectra").count() == 4 and {r["f_med"] for r in segments.read(spark, str(tmp_path / "o"), "aux").collect()} == {0.0, 10.0}
    p.write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        calib.load_data(spark, str(tmp_path / "m"))


def test_sky_glint(spark):
    """Under an even sky without sun, calm water mirrors as a flat one does, and wind adds to it at a slant view."""
    from shoalspark.operators import skyglint

    z = [0.05] + [math.acos(c) for c in np.linspace(0.95, 0.05, 19) for _ in range(36)]
    a = [0.0] + [x for _ in range(19) for x in np.linspace(-math.pi, math.pi, 37)[:-1]]
    tables = skyglint.SkyTables(np.array(z), np.array(a), 0.05, 2 * math.pi / 36, np.array([0, 40.0, 80.0]), np.array([0, 0.5]), np.array([400.0, 800.0]), np.ones((3, 2, len(z), 2)), np.zeros((3, 2, 2)))
    wl = [450.0, 700.0]
    flat = skyglint.reflectance(skyglint.water_index(np.array(wl), 17, 30), np.radians([40.0]))[0]
    calm, windy = (skyglint.sky_and_sun(tables, wl, 30, 40, 135, 0.1, w) for w in (0.5, 10))
    assert calm["sky"] == pytest.approx(flat, rel=0.03) and (windy["sky"] > calm["sky"]).all() and (calm["sun"] == 0).all()
    # all facets together mirror one whole
    normals = skyglint.facet_share(skyglint.disk(0.0, 0.2)[None], skyglint.direction(np.array(0.0), np.array(0.0)), 5.0)[0][0]
    assert 0 < normals < 1
    with pytest.raises(ValueError):
        skyglint.sky_and_sun(tables, wl, 85, 40, 135, 0.1, 5)
    with pytest.raises(Exception, match="outside"):
        lut.checked(spark.createDataFrame([(9.0,)], "x double"), lut.LutSpec({"x": [0, 1]}, ["v"])).collect()


def test_spectra_resampled_at_a_sensor(spark):
    df = spark.createDataFrame([([500.0, 400.0], [2.0, 1.0]), ([450.0], [7.0]), ([], []), (None, None), ([400.0, 500.0], [None, 2.0])], "w array<double>, v array<double>")
    got = [r[0] for r in df.select(spectral.resampled("w", "v", [390, 425, 500, 900])).collect()]
    assert got == [[1.0, 1.25, 2.0, 2.0], [7.0] * 4, None, None, [None, None, 2.0, 2.0]]


def test_matchups_of_array_rows_as_of_long_rows(spark):
    wl = [450.0, 550.0]
    terms = {"path": 0.02, "t_ra": 0.9, "s_ra": 0.1, "glint": 0.001, "t_gas": 0.95}
    px = spark.range(25).select(F.expr("cast(id div 5 as int)").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit("i").alias("image_name"), F.array(F.col("id") / 100, F.col("id") / 50).alias("rho_t"), F.expr("timestamp'2024-01-01 12:00:00'").alias("acq"))
    arrays = px.select("*", *[F.array(*[F.lit(v)] * 2).alias(k) for k, v in terms.items()])
    long = px.select("row", "col", "x", "y", "image_name", "acq", F.inline(F.arrays_zip(F.array(*map(F.lit, wl)).alias("wavelength"), "rho_t")))
    pts = matchup.windows(spark.createDataFrame([("u", 2.5, 2.5), ("v", 0.5, 4.5), ("none", 1.5, 1.5)], "uuid string, px double, py double"), "px", "py", (1, 0, 0, 0, 1, 0), 5, 5, 3)
    ins = spark.createDataFrame([(u, "2024-01-01 10:00:00", w, w / 10000) for u in "uv" for w in (400.0, 500.0)], "uuid string, date_time string, wavelength double, rho double").withColumn("date_time", F.to_timestamp("date_time"))
    a = correction.matchup_bands(arrays, wl, ins, pts, "acq", land=True, tile=2)
    b = correction.matchups(long, long.select("row", "col", "wavelength", *[F.lit(v).alias(k) for k, v in terms.items()]), ins, pts, "acq", land=True)
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.select(*a.columns).collect())) and a.count() == 2 * (9 + 4)


def test_scenes_of_an_archive_as_one_by_one(spark):
    wl = [550.0, 800.0]
    s, g = spec(), lut.LutSpec({"sun_zenith": [0, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "water": [0, 2, 5]}, ["t_gas"])
    aer, gas = lut.synthetic(spark, s, wl), lut.synthetic(spark, g, wl)
    px = spark.createDataFrame([(i, k, 10.0 * k + 5, 5.0, 90.0, [6.0 + k, 2.0]) for i in range(5) for k in range(4)], "image_id int, k int, sun_zenith double, view_zenith double, relative_azimuth double, radiance array<double>")
    scalars = {0: (0.1, 1013.0, 2.0), 1: (0.0, 950.0, 0.0), 2: (0.05, 1000.0, 5.0), 3: (99.0, 1000.0, 1.0)}  # 3: outside; 4: not there
    scenes = spark.createDataFrame([(i, *v, [100.0 + i, 90.0]) for i, v in scalars.items()], "image_id int, aot550 double, pressure double, water double, f0 array<double>")
    got = {(r["image_id"], r["k"]): r for r in correction.archive_l1_to_l2(px, scenes, wl, aer, s, gas, g).collect()}
    assert len(got) == 20 and all(got[i, k]["rho_s"] is None for i in (3, 4) for k in range(4))
    for i in range(3):
        aot, ps, wv = scalars[i]
        one = correction.l1_to_l2(px.where(F.col("image_id") == i), wl, [100.0 + i, 90.0], aer, s, gas, g, {"aot550": aot, "pressure": ps, "water": wv})
        for r in one.collect():
            assert got[i, r["k"]]["rho_s"] == (r["rho_s"] and pytest.approx(r["rho_s"])) and got[i, r["k"]]["rho_w"] == (r["rho_w"] and pytest.approx(r["rho_w"]))


def test_pixels_of_an_archive_are_not_shuffled(spark):
    s, g = spec(), lut.LutSpec({"sun_zenith": [0, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "water": [0, 5]}, ["t_gas"])
    px = spark.range(3).select(F.col("id").cast("int").alias("image_id"), *[F.lit(5.0).alias(a) for a in lut.PIXEL_AXES], F.array(F.lit(1.0)).alias("radiance"))
    scenes = spark.createDataFrame([(1, 0.1, 1000.0, 1.0, [100.0])], "image_id int, aot550 double, pressure double, water double, f0 array<double>")
    out = correction.archive_l1_to_l2(px, scenes, [550.0], lut.synthetic(spark, s, [550.0]), s, lut.synthetic(spark, g, [550.0]), g)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_dark_spectra_choose_aerosol_and_model(spark):
    """Path reflectance made with a known AOD and model is what both are found from."""
    wl = [500.0, 600.0, 700.0]
    s = lut.LutSpec({"sun_zenith": [0, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "aot550": [0, 0.1, 0.4], "pressure": [900, 1050]}, ["path", "t_ra", "s_ra", "glint"])
    g = lut.LutSpec({"sun_zenith": [0, 60], "view_zenith": [0, 20], "relative_azimuth": [0, 180], "water": [0, 5]}, ["t_gas"])
    grid = s.grid(spark).select("*", F.posexplode(F.array(*map(F.lit, wl))).alias("wl_idx", "wavelength"))
    a = {"flat": grid.withColumn("path", 0.02 + F.col("aot550") * 0.2), "blue": grid.withColumn("path", 0.02 + F.col("aot550") * 0.2 * 700 / F.col("wavelength"))}
    a = {k: v.withColumns({"t_ra": F.lit(0.9), "s_ra": F.lit(0.1), "glint": F.lit(0.0)}).drop(*s.axes) for k, v in a.items()}
    truth = {0: (0.25, "blue"), 1: (0.05, "flat"), 2: (9.0, "flat")}  # the last is outside
    path = lambda i, w: 0.02 + truth[i][0] * 0.2 * (700 / w if truth[i][1] == "blue" else 1)
    rows = [(i, r, c, 30.0, 5.0, 90.0, [(path(i, w) + 0.01 * (r + c)) * 100 * math.cos(math.radians(30)) / math.pi for w in wl]) for i in range(3) for r in range(3) for c in range(3)]
    px = spark.createDataFrame(rows, "image_id int, row int, col int, sun_zenith double, view_zenith double, relative_azimuth double, radiance array<double>")
    scenes = spark.createDataFrame([(i, 1000.0, 1.0, [100.0] * 3) for i in range(3)] + [(7, 1000.0, 1.0, [100.0] * 3)], "image_id int, pressure double, water double, f0 array<double>")
    aod = {r["image_id"]: r for r in correction.dark_aod(correction.l1r(px, wl, [100.0] * 3), scenes, a, s).collect()}
    for i in (0, 1):
        assert aod[i]["aot550"] == pytest.approx(truth[i][0]) and aod[i]["aerosol_model"] == truth[i][1] and aod[i]["n_bands"] == 3
    assert aod[2]["aot550"] is None and aod[7]["aerosol_model"] is None
    out = correction.archive_dark_l1_to_l2(px, scenes, wl, a, s, lut.synthetic(spark, g, wl), g).collect()
    assert len(out) == 27 and all((r["rho_s"] is None) == (r["image_id"] == 2) for r in out)
    assert {r["image_id"]: r["aerosol_model"] for r in out} == {0: "blue", 1: "flat", 2: None}


def test_mean_spectra_of_windows_that_many_points_share(spark):
    px = spark.range(40).where("id <> 13").selectExpr("cast(id div 5 as int) as row", "cast(id % 5 as int) as col", "array(id / 7, if(id % 4 = 0, null, id * 1.5)) as s")
    pts = matchup.windows(spark.range(400).selectExpr("if(id < 9, id div 3, id) as uuid", "(id * 7 % 50) / 10 as x", "(id * 11 % 80) / 10 as y"), "x", "y", (1, 0, 0, 0, 1, 0), 8, 5, 3)
    for some in (pts, pts.where("uuid > 8")):  # with and without repeated ids
        plain = matchup.window_means(matchup.window_join(px, some, 4).select("uuid", F.posexplode("s").alias("wl_idx", "value")), ("uuid", "wl_idx"))
        want = {(r["uuid"], r["wl_idx"]): (r["mean"], r["n"]) for r in plain.collect()}
        got = matchup.window_spectra(px, "s", some, 4).collect()
        assert len(got) == len(want) > 700
        for r in got:
            mean, n = want[r["uuid"], r["wl_idx"]]
            assert r["n"] == n and r["mean"] == (mean if mean is None else pytest.approx(mean))


def test_means_of_matchups_as_over_their_rows(spark):
    wl = [450.0, 550.0]
    term = lambda v: F.array(F.lit(v) + F.col("id") % 2 / 100, F.lit(v))  # noqa: E731  the first band's terms differ inside a window
    px = spark.range(25).select(F.expr("cast(id div 5 as int)").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit("i").alias("image_name"), F.array(F.col("id") / 100, F.when(F.col("id") % 3 > 0, F.col("id") / 50)).alias("rho_t"), F.expr("timestamp'2024-01-01 12:00:00'").alias("acq"), *[term(v).alias(k) for k, v in {"path": 0.02, "t_ra": 0.9, "s_ra": 0.1, "glint": 0.001, "t_gas": 0.95}.items()])
    pts = matchup.windows(spark.createDataFrame([("u", 2.5, 2.5), ("v", 0.5, 4.5), ("w", 0.5, 4.5), ("two", 1.5, 1.5), ("two", 4.5, 0.5), ("late", 2.5, 2.5)], "uuid string, px double, py double"), "px", "py", (1, 0, 0, 0, 1, 0), 5, 5, 3)
    when = {"late": ["2024-01-03 10:00:00"], "w": ["2024-01-01 10:00:00", "2024-01-01 11:00:00"]}
    ins = spark.createDataFrame([(u, t, w, w / 10000 + len(u) / 100) for u in ("u", "v", "w", "two", "late") for t in when.get(u, ["2024-01-01 10:00:00"]) for w in (400.0, 500.0)], "uuid string, date_time string, wavelength double, rho double").withColumn("date_time", F.to_timestamp("date_time"))
    for some in (pts, pts.where("uuid <> 'two'")):
        plain = correction.matchup_bands(px, wl, ins, some, "acq", tile=2).groupBy("uuid", "wavelength").agg(F.count("*").alias("n"), F.avg("rho_t").alias("a"), F.avg("rho_t_hat").alias("b"))
        want = {(r["uuid"], wl.index(r["wavelength"])): (r["n"], r["a"], r["b"]) for r in plain.collect()}
        got = {(r["uuid"], r["wl_idx"]): (r["n"], r["rho_t"], r["rho_t_hat"]) for r in correction.matchup_means(px, wl, ins, some, "acq", tile=2).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

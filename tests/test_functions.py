"""Expressions against closed forms, limits and round trips."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shoalspark.functions import geo
from shoalspark.functions import physics as ph


def value(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def lit(x):
    return F.lit(float(x))


def test_exact_inverse_undoes_the_forward_model(spark):
    for rho in (0.0, 0.01, 0.2):
        terms = [lit(0.95), lit(0.02), lit(0.8), lit(0.15)]
        up = ph.atmosphere_forward(lit(rho), *terms)
        assert value(spark, ph.atmosphere_inverse(up, *terms, exact=True)) == pytest.approx(rho, abs=1e-12)
        assert value(spark, ph.atmosphere_inverse_path_gas(lit(0.1), *terms)) is not None
    y = 0.1 / 0.95 - 0.02
    assert value(spark, ph.atmosphere_inverse(lit(0.1), *terms)) == pytest.approx(y / 0.8 + 0.15 * y)


def test_glint_is_added_over_water_only(spark):
    terms = [lit(1), lit(0), lit(1), lit(0)]
    assert value(spark, ph.surface_to_sensor(lit(0.1), lit(0.02), F.lit(True), *terms), ph.surface_to_sensor(lit(0.1), lit(0.02), F.lit(False), *terms)) == pytest.approx((0.1, 0.12))


def test_ndwi_and_mask(spark):
    n = ph.ndwi(lit(0.2), lit(0.1))
    assert value(spark, n, ph.water_mask(n), ph.water_mask(ph.ndwi(lit(0), lit(0))), ph.water_mask(lit("nan"))) == (pytest.approx(1 / 3), 1, 0, 0)


def test_validity(spark):
    s = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    assert value(spark, ph.valid(s(1, 2)), ph.valid(s(1, None)), ph.valid(s(1, float("nan"))), ph.valid(s(-1, 2), True), ph.valid(F.lit(None).cast("array<double>"))) == (True, False, False, False, False)


def test_toa_reflectance(spark):
    r = value(spark, ph.toa_reflectance(F.array(lit(10), lit(20)), [100.0, 0.0], lit(60), [2.0, 2.0], [0.5, 0.5]))
    assert r[0] == pytest.approx(2 * math.pi * 10 / 50 + 0.5) and r[1] is None


def test_reflectance_conversions_invert(spark):
    for rho in (0.001, 0.05, 0.3):
        assert value(spark, ph.rrs0m_to_rho(ph.rho_to_rrs0m(lit(rho)))) == pytest.approx(rho)
    assert value(spark, ph.rrs0m_to_rho(lit(1.0))) is None
    h = 1e-6
    f = lambda x: x / math.pi / (0.52 + 1.7 * x / math.pi)
    assert value(spark, ph.sigma_to_rrs0m(lit(0.1), lit(0.01))) == pytest.approx((f(0.1 + h) - f(0.1 - h)) / (2 * h) * 0.01, rel=1e-5)
    assert value(spark, ph.sigma_to_rrs0m_direct(lit(0.0))) == 1e-5


def test_fresnel_limits(spark):
    n = lit(1.34)
    assert value(spark, ph.fresnel(lit(0), n)) == pytest.approx(((1 - 1.34) / (1 + 1.34)) ** 2)
    assert value(spark, ph.fresnel(lit(0.01), n)) == pytest.approx(((1 - 1.34) / (1 + 1.34)) ** 2, rel=1e-4)
    assert value(spark, ph.fresnel(lit(89.999), n)) > 0.99


def test_refraction_and_rayleigh(spark):
    assert 1.33 < value(spark, ph.water_index(lit(550))) < 1.35
    a, b = value(spark, ph.rayleigh_tau(lit(550)), ph.rayleigh_tau_bodhaine(lit(550), published=True))
    assert a == pytest.approx(0.098, abs=2e-3) and b == pytest.approx(a, rel=0.02)
    default = value(spark, ph.rayleigh_tau_bodhaine(lit(550)))
    r = 0.78084 * (0.034 + 3.17e-4 / 0.3025) + 0.20946 * (0.096 + 1.385e-3 / 0.3025 + 1.448e-4 / 0.3025**2) + 400e-6 * 0.15
    assert default / b == pytest.approx((6 + 3 * r) / (6 - 7 * r) / (1 + r) * (976.0 / 980.6), rel=0.01)  # another King factor, sea-level gravity
    assert value(spark, ph.rayleigh_phase(lit(0), lit(0), lit(0))) == pytest.approx(1.5)
    assert value(spark, ph.sky_glint(lit(550), lit(30), lit(10), lit(90))) > 0


def test_bottom_solve_undoes_the_water_model(spark):
    a, bb = lit(0.3), lit(0.02)
    for depth, rb in ((1, 0.2), (3, 0.05)):
        rrs = ph.am03_rrs(a, bb, lit(40), lit(5), lit(depth), lit(rb))
        assert value(spark, ph.am03_bottom(rrs, a, bb, lit(40), lit(5), lit(depth))) == pytest.approx(rb)
    deep, far = value(spark, ph.am03_rrs(a, bb, lit(40), lit(5)), ph.am03_rrs(a, bb, lit(40), lit(5), lit(200), lit(0.5)))
    assert deep == pytest.approx(far)
    assert value(spark, ph.am03_bottom(lit(0.01), lit(50), lit(0.02), lit(40), lit(5), lit(30))) == 0


def test_packing(spark):
    p = ph.pack(lit(0.12345), 1e-3)
    assert value(spark, p, ph.unpack(p, 1e-3), ph.unpack(ph.pack(F.lit(None).cast("double"), 1e-3), 1e-3)) == (123, pytest.approx(0.123), None)


def test_names_and_colours(spark):
    assert tuple(value(spark, ph.cf_name(F.lit("sun_zenith")))) == ("solar_zenith_angle", "degree")
    assert value(spark, ph.cf_name(F.lit("nothing"))) is None
    white = value(spark, ph.rgb_to_lab(lit(1), lit(1), lit(1)))
    assert (white["l"], white["a"], white["b"]) == (pytest.approx(100, abs=0.01), pytest.approx(0, abs=0.02), pytest.approx(0, abs=0.02))


def test_srf_and_distance(spark):
    srf = value(spark, ph.gaussian_srf(550.0, 5.0, 0.1))
    half = [x["wl"] for x in srf if x["response"] >= 0.5]
    assert max(x["response"] for x in srf) == pytest.approx(1, abs=1e-3) and half[-1] - half[0] == pytest.approx(5, abs=0.2)
    assert value(spark, ph.earth_sun_factor(lit(2))) == pytest.approx(1.034)


def test_julian_day(spark):
    ts = lambda s: F.lit(dt.datetime.fromisoformat(s)).cast("timestamp")
    assert value(spark, geo.julian_day(ts("2000-01-01 12:00:00")), geo.julian_day(ts("1987-01-27 00:00:00"))) == (2451545.0, 2446822.5)


def test_sun(spark):
    rows = [(dt.datetime(2024, 3, 20, 12, 7), 0.0, 0.0), (dt.datetime(2024, 6, 21, 12, 0), 45.0, 0.0), (dt.datetime(2024, 6, 21, 16, 0), 45.0, 0.0), (dt.datetime(2024, 6, 21, 8, 0), 45.0, 0.0)]
    got = geo.with_sun_position(spark.createDataFrame(rows, "ts timestamp, lat double, lon double"), "ts", "lat", "lon").orderBy("ts").collect()
    assert got[0]["sun_zenith"] < 1
    noon = got[2]
    assert noon["sun_zenith"] == pytest.approx(45 - 23.44, abs=0.1) and noon["sun_azimuth"] == pytest.approx(180, abs=2)
    assert got[1]["sun_azimuth"] < 180 < got[3]["sun_azimuth"]
    d = value(spark, geo.declination(F.lit(dt.datetime(2024, 6, 21)).cast("timestamp")))
    assert d == pytest.approx(23.44, abs=0.1)
    z, _ = value(spark, *geo.sun_from_hour_angle(lit(45), lit(10), F.lit(d)))
    assert z == pytest.approx(45 - d, abs=5)


def test_grids(spark):
    affine = (2.0, 0.0, 100.0, 0.0, -2.0, 200.0)
    assert value(spark, *geo.grid_xy(F.lit(3), F.lit(4), affine)) == (107.0, 191.0)
    assert value(spark, *geo.grid_xy(F.lit(3), F.lit(4), affine, "ul")) == (106.0, 192.0)
    assert value(spark, *geo.grid_rowcol(lit(107), lit(191), affine)) == (4, 3)
    assert value(spark, geo.nearest_index(lit(-50), 1.0, 2.0, 10), geo.nearest_index(lit(6.2), 1.0, 2.0, 10), geo.nearest_index(lit(99), 1.0, 2.0, 10)) == (0, 3, 9)


def test_view_and_azimuth(spark):
    z, a = value(spark, *geo.view_angles(F.lit(0), 500, 1.0, 1000.0, 350.0))
    assert z == pytest.approx(math.degrees(math.atan(249.5 / 1000))) and a == 80
    assert value(spark, geo.relative_azimuth(lit(350), lit(10)), geo.relative_azimuth(lit(350), lit(10), True)) == (340, 20)


def test_projection_round_trip(spark):
    x, y = value(spark, *geo.tm_forward(lit(49.81), lit(-64.365), -63.0))
    assert (x, y) == (pytest.approx(401_800, abs=700), pytest.approx(5_518_500, abs=2000))
    lat, lon = value(spark, *geo.tm_inverse(lit(x), lit(y), -63.0))
    assert (lat, lon) == (pytest.approx(49.81, abs=1e-8), pytest.approx(-64.365, abs=1e-8))


def test_both_signs_of_the_bottom_term(spark):
    import math

    a, bb, cs, cv = 0.3, 0.02, math.cos(math.asin(math.sin(math.radians(40)) / 1.34)), math.cos(math.asin(math.sin(math.radians(5)) / 1.34))
    w, e = bb / (a + bb), a + bb
    for published, sign in ((False, -1), (True, 1)):
        deep, shallow = value(spark, ph.am03_rrs(lit(a), lit(bb), lit(40), lit(5)), ph.am03_rrs(lit(a), lit(bb), lit(40), lit(5), lit(2), lit(0.2), published=published))
        kd, kw = 1.0546 * e / cs, e / cv * (1 + w) ** 3.5421 * (1 - 0.2786 / cs)
        kb = e / cv * (1 + w) ** 2.2658 * (1 + sign * 0.0577 / cs)
        assert shallow == pytest.approx(deep * (1 - 1.1576 * math.exp(-2 * (kd + kw))) + 1.0389 * 0.2 / math.pi * math.exp(-2 * (kd + kb)), rel=1e-9)


def test_arcs_of_the_ellipsoid(spark):
    assert value(spark, geo.meridian_arc(lit(90)), geo.meridian_arc(lit(-45))) == (pytest.approx(10_001_965.73, abs=0.01), pytest.approx(-4_984_944.38, abs=0.01))
    assert value(spark, geo.parallel_arc(lit(0), lit(360)), geo.parallel_arc(lit(60), lit(1))) == (pytest.approx(40_075_016.69, abs=0.01), pytest.approx(55_800, abs=1))

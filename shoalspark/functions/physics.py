"""Radiometry and water optics as Column expressions.

Everything here runs inside the JVM. Spectra are ``array<double>`` columns,
index-aligned with the scene's wavelengths; per-wavelength constants are
passed as Python lists and become literals. Missing values are NULL: divisions
by zero and logarithms of nothing give NULL, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Spectrum = Column | Sequence[float]


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def spectrum(x: Column | str | Sequence[float]) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*[F.lit(float(v)) for v in x])
    return col(x)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def each(f: Callable[..., Column], *spectra: Column | str | Sequence[float]) -> Column:
    """``f`` of the values of several spectra at each band."""
    arrays = [spectrum(s) for s in spectra]
    if len(arrays) == 1:
        return F.transform(arrays[0], f)
    if len(arrays) == 2:
        return F.zip_with(arrays[0], arrays[1], f)
    packed = F.arrays_zip(*[a.alias(f"c{i}") for i, a in enumerate(arrays)])
    return F.transform(packed, lambda x: f(*[x[f"c{i}"] for i in range(len(arrays))]))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clamp01(x: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# --- sun and sensor ---------------------------------------------------------


def earth_sun_factor(doy: Column, amplitude: float = 0.034, origin: int = 2) -> Column:
    """1 + a cos(2 pi (doy - d0) / 365); (0.033412, 3) is the other published pair."""
    return 1 + amplitude * F.cos(2 * math.pi * (doy - origin) / 365)


def gaussian_sigma(fwhm: float) -> float:
    return fwhm / (2 * math.sqrt(2 * math.log(2)))


def gaussian_response(wl: Column, center: Column, fwhm: Column) -> Column:
    """Peak-one Gaussian spectral response; NULL beyond four sigma."""
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    d = wl - center
    return F.when(F.abs(d) <= 4 * sigma, F.exp(-0.5 * (d / sigma) * (d / sigma)))


def gaussian_srf(center: float, fwhm: float, step: float = 0.001) -> Column:
    """array<struct<wl, response>> within four sigma."""
    s = gaussian_sigma(fwhm)
    n = int(8 * s / step)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(center - 4 * s) + i * step)
    return F.transform(grid, lambda w: F.struct(w.alias("wl"), F.exp(-0.5 * ((w - center) / s) * ((w - center) / s)).alias("response")))


def response(tabulated: Column, center: float | None = None, fwhm: float | None = None, step: float = 0.1) -> Column:
    """A band's response: the tabulated one if there is any, else a Gaussian if its width is known, else NULL."""
    return F.coalesce(tabulated, gaussian_srf(center, fwhm, step)) if center is not None and fwhm is not None else tabulated


def toa_reflectance(radiance: Column | str, f0: Spectrum, sun_zenith: Column, gain: Spectrum | None = None, offset: Spectrum | None = None) -> Column:
    """pi L / (F0 cos(sun)), then the calibration: gain * rho (+ offset)."""
    cos = F.cos(F.radians(sun_zenith))
    rho = each(lambda l, f: div(math.pi * l, f * cos), radiance, f0)
    if gain is not None:
        rho = each(lambda r, g: r * g, rho, gain)
    if offset is not None:
        rho = each(lambda r, o: r + o, rho, offset)
    return rho


# --- indices and masks --------------------------------------------------------


def ndwi(green: Column, nir: Column) -> Column:
    return div(green - nir, green + nir)


def water_mask(index: Column, threshold: float = 0.0) -> Column:
    """1 over water, else 0; NULL and NaN are 0."""
    return F.when(index.isNotNull() & ~F.isnan(index) & (index > threshold), 1).otherwise(0).cast("byte")


def valid(s: Column | str, nonnegative: bool = False) -> Column:
    """All bands present and finite (and not negative)."""

    def good(x: Column) -> Column:
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return ok & (x >= 0) if nonnegative else ok

    return F.coalesce(F.forall(col(s), good), F.lit(False))


# --- atmosphere -------------------------------------------------------------


def atmosphere_inverse(rho_t: Column, t_gas: Column, path: Column, t_ra: Column, s_ra: Column, exact: bool = False) -> Column:
    """Surface reflectance from TOA. Default is y/t + s y; ``exact`` is y/(t + s y), the inverse of forward()."""
    y = div(rho_t, t_gas) - path
    return div(y, t_ra + s_ra * y) if exact else div(y, t_ra) + s_ra * y


def atmosphere_inverse_path_gas(rho_t: Column, t_gas: Column, path: Column, t_ra: Column, s_ra: Column) -> Column:
    """The older form: path scaled by gas and coupling, then (rho - p)/(T + S(rho - p))."""
    p = div(path * t_gas, 1 - path * s_ra)
    return div(rho_t - p, t_ra * t_gas + s_ra * (rho_t - p))


def atmosphere_forward(rho_s: Column, t_gas: Column, path: Column, t_ra: Column, s_ra: Column) -> Column:
    return t_gas * (path + div(t_ra * rho_s, 1 - s_ra * rho_s))


def surface_to_sensor(rho_w: Column, glint: Column, land: Column, t_gas: Column, path: Column, t_ra: Column, s_ra: Column) -> Column:
    """Forward model of a matchup: glint is added over water only."""
    return atmosphere_forward(F.when(land, rho_w).otherwise(rho_w + glint), t_gas, path, t_ra, s_ra)


def coupled_sensor_reflectance(rrs0m: Column, path: Column, t_ra: Column, s_ra: Column) -> Column:
    """Water reflectance through the surface and the atmosphere; path alone where the coupling breaks down."""
    rho = math.pi * F.greatest(div(0.518 * rrs0m, 1 - 1.562 * rrs0m), F.lit(0.0))
    d = 1 - s_ra * rho
    return F.when(d < 1e-6, path).otherwise(path + div(t_ra * rho, d))


def water_leaving(rho_s: Column, glint: Column, mask: Column) -> Column:
    return F.when(mask == 1, rho_s - glint)


def glint_from_nir(rho_w: Column | str, fresnel: Sequence[float], nir_index: int) -> Column:
    """rho - r(band) * rho(nir) / r(nir), band by band."""
    nir = F.get(spectrum(rho_w), F.lit(nir_index)) / fresnel[nir_index]
    return each(lambda r, f: r - f * nir, rho_w, list(fresnel))


# --- refraction and reflection --------------------------------------------------


def water_index(wl: Column, temperature: float = 12.0, salinity: float = 30.0) -> Column:
    """Refractive index of sea water (Quan & Fry 1995), wavelength in nm."""
    t, s = temperature, salinity
    flat = 1.31405 + (1.779e-4 - 1.05e-6 * t + 1.6e-8 * t * t) * s - 2.02e-6 * t * t
    return flat + (15.868 + 0.01155 * s - 0.00423 * t) / wl - 4382 / (wl * wl) + 1.1455e6 / (wl * wl * wl)


def fresnel_nadir(n: Column) -> Column:
    return ((1 - n) / (1 + n)) * ((1 - n) / (1 + n))


def fresnel(theta_deg: Column, n: Column) -> Column:
    """Unpolarised Fresnel reflectance of a flat surface; the nadir limit at theta = 0."""
    a = F.radians(theta_deg)
    b = F.asin(F.sin(a) / n)
    s = div(F.sin(a - b), F.sin(a + b))
    p = div(F.tan(a - b), F.tan(a + b))
    return F.when(F.abs(a) < 1e-9, fresnel_nadir(n)).otherwise(0.5 * (s * s + p * p))


def rayleigh_tau(wl_nm: Column, pressure: Column | float = 1013.25) -> Column:
    """Rayleigh optical depth (Hansen & Travis 1974)."""
    u = wl_nm / 1000
    i2 = 1 / (u * u)
    return col(pressure) / 1013.25 * 0.008569 * i2 * i2 * (1 + 0.0113 * i2 + 0.00013 * i2 * i2)


def rayleigh_tau_bodhaine(wl_nm: Column, pressure_hpa: float = 1013.25, co2_ppm: float = 400.0, lat_deg: float = 45.0, z_m: float = 0.0, published: bool = False, co2_added: bool = False) -> Column:
    """Rayleigh optical depth (Bodhaine et al. 1999) at sea-level gravity; ``z_m`` counts only in the published form.

    CO2 scales the refractive index of air as the paper has it; with ``co2_added`` it adds 1.15e-8 for each ppm above
    300, some 0.8 % of the depth at 400 ppm.

    The default's King factor is (6 + 3 r) / (6 - 7 r) of the mixture's r, the sum of the gases' factors less one by
    volume; ``published`` takes the paper's volume-weighted factor and its gravity at the altitude.
    """
    u = wl_nm / 1000
    i2 = 1 / (u * u)
    n300 = (8060.51 + 2480990 / (132.274 - i2) + 17455.7 / (39.32957 - i2)) / 1e8
    n1 = n300 + (co2_ppm - 300) * 1.15e-8 if co2_added else n300 * (1 + 0.54 * (co2_ppm * 1e-6 - 0.0003))
    n = n1 + 1
    f_n2 = 1.034 + 3.17e-4 * i2
    f_o2 = 1.096 + 1.385e-3 * i2 + 1.448e-4 * i2 * i2
    c = co2_ppm * 1e-4
    if published:
        king = (78.084 * f_n2 + 20.946 * f_o2 + 0.934 + c * 1.15) / (78.084 + 20.946 + 0.934 + c)
    else:
        r = 0.78084 * (f_n2 - 1) + 0.20946 * (f_o2 - 1) + co2_ppm * 1e-6 * 0.15
        king = (6 + 3 * r) / (6 - 7 * r)
    ns = 2.546899e19
    wl_cm = u * 1e-4
    n2 = n * n
    sigma = 24 * math.pi**3 * (n2 - 1) * (n2 - 1) / (wl_cm * wl_cm * wl_cm * wl_cm * ns * ns * (n2 + 2) * (n2 + 2)) * king
    air = 15.0556 * co2_ppm * 1e-6 + 28.9595
    c2 = math.cos(2 * math.radians(lat_deg))
    zc = 0.73737 * z_m + 5517.56
    g = 980.6160 * (1 - 0.0026373 * c2 + 0.0000059 * c2 * c2)
    if published:
        g += -(3.085462e-4 + 2.27e-7 * c2) * zc + (7.254e-11 + 1.0e-13 * c2) * zc**2 - (1.517e-17 + 6e-20 * c2) * zc**3
    return sigma * (pressure_hpa * 1000 * 6.0221367e23 / (air * g))


def rayleigh_phase(sun_deg: Column, view_deg: Column, azimuth_deg: Column) -> Column:
    s, v, a = F.radians(sun_deg), F.radians(view_deg), F.radians(azimuth_deg)
    c = F.cos(s) * F.cos(v) - F.sin(s) * F.sin(v) * F.cos(a)
    return 0.75 * (1 + c * c)


def rayleigh_transmittance(tau: Column, sun_deg: Column, view_deg: Column) -> Column:
    return F.exp(-tau / 2 * (1 / F.cos(F.radians(sun_deg)) + 1 / F.cos(F.radians(view_deg))))


def sky_glint(wl_nm: Column, sun_deg: Column, view_deg: Column, azimuth_deg: Column, pressure: Column | float = 1013.25) -> Column:
    """Rayleigh sky light mirrored by a flat surface."""
    n = water_index(wl_nm)
    both = fresnel(sun_deg, n) + fresnel(view_deg, n)
    cosines = F.cos(F.radians(sun_deg)) * F.cos(F.radians(view_deg))
    return rayleigh_tau(wl_nm, pressure) * both * rayleigh_phase(sun_deg, view_deg, azimuth_deg) / (4 * cosines)


def cox_munk_sigma(wind: Column) -> Column:
    return F.sqrt(0.003 + 0.00512 * wind)


# --- water column ------------------------------------------------------------


def rho_to_rrs0m(rho: Column, a: float = 0.52, b: float = 1.7) -> Column:
    r = rho / math.pi
    return div(r, a + b * r)


def rrs0m_to_rho(r: Column, a: float = 0.52, b: float = 1.7) -> Column:
    return F.when(1 - b * r > 1e-12, math.pi * a * r / (1 - b * r))


def sigma_to_rrs0m(rho: Column, sigma: Column, floor: float = 1e-8) -> Column:
    """First-order error of rho_to_rrs0m()."""
    d = 0.52 + 1.7 * rho / math.pi
    return F.greatest(0.52 / (d * d) * sigma / math.pi, F.lit(floor))


def sigma_to_rrs0m_direct(sigma: Column, floor: float = 1e-5) -> Column:
    """The conversion applied to the error itself."""
    return F.greatest(rho_to_rrs0m(sigma), F.lit(floor))


def rho_sigma(mad: Column) -> Column:
    """1.4826 MAD in [1e-6, 0.2]."""
    return F.least(F.greatest(1.4826 * mad, F.lit(1e-6)), F.lit(0.2))


def water_backscatter(wl: Column) -> Column:
    return 0.00111 * F.pow(wl / 500, F.lit(-4.32))


def absorption(wl: Column, a_w: Column, a0: Column, a1: Column, chl: Column, ag440: Column, spm: Column, s_g: Column, anap: Column, s_nap: Column) -> Column:
    """Water, phytoplankton, dissolved and particulate matter."""
    aph = 0.06 * F.pow(chl, F.lit(0.65))
    phyto = F.greatest((a0 + a1 * F.ln(aph)) * aph, F.lit(0.0))
    return a_w + phyto + ag440 * F.exp(-s_g * (wl - 440)) + anap * spm * F.exp(-s_nap * (wl - 440))


def backscatter(wl: Column, bb_w: Column, spm: Column, bbp: Column, gamma: Column) -> Column:
    return bb_w + bbp * spm * F.pow(wl / 550, -gamma)


def _am03(a: Column, bb: Column, sun_deg: Column, view_deg: Column, water_type: int, published: bool) -> tuple[Column, ...]:
    n = 1.34
    cs = F.cos(F.asin(F.sin(F.radians(sun_deg)) / n))
    cv = F.cos(F.asin(F.sin(F.radians(view_deg)) / n))
    ext = a + bb
    w = div(bb, ext)
    if water_type == 1:
        f, k0 = F.lit(0.095), 1.0395
    else:
        f, k0 = 0.0512 * (1 + 4.6659 * w - 7.8387 * w * w + 5.4571 * w * w * w) * (1 + 0.1098 / cs) * (1 + 0.4021 / cv), 1.0546
    kd = k0 * ext / cs
    ku_w = ext / cv * F.pow(1 + w, F.lit(3.5421)) * (1 - 0.2786 / cs)
    ku_b = ext / cv * F.pow(1 + w, F.lit(2.2658)) * (1 + (0.0577 if published else -0.0577) / cs)
    return f, w, kd, ku_w, ku_b


def am03_rrs(a: Column, bb: Column, sun_deg: Column, view_deg: Column, depth: Column | None = None, bottom: Column | None = None, water_type: int = 2, published: bool = False) -> Column:
    """Subsurface reflectance (Albert & Mobley 2003), deep unless a depth and a bottom are given.

    Light from the bottom is attenuated with 1 - 0.0577 / cos(sun) in water; ``published``: with the paper's plus sign.
    """
    f, w, kd, ku_w, ku_b = _am03(a, bb, sun_deg, view_deg, water_type, published)
    if depth is None:
        return f * w
    return f * w * (1 - 1.1576 * F.exp(-depth * (kd + ku_w))) + 1.0389 * (bottom / math.pi) * F.exp(-depth * (kd + ku_b))


def am03_bottom(rrs: Column, a: Column, bb: Column, sun_deg: Column, view_deg: Column, depth: Column, water_type: int = 2, published: bool = False) -> Column:
    """Bottom reflectance that explains ``rrs``; 0 where it can't be told."""
    f, w, kd, ku_w, ku_b = _am03(a, bb, sun_deg, view_deg, water_type, published)
    column = f * w * (1 - 1.1576 * F.exp(-depth * (kd + ku_w)))
    term = 1.0389 / math.pi * F.exp(-depth * (kd + ku_b))
    r = F.when(term > 1e-30, (rrs - column) / term)
    return F.coalesce(nan_to_null(r), F.lit(0.0))


# --- ancillary --------------------------------------------------------------


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.degrees(F.atan2(u, v))


def ancillary(u: Column, v: Column, ps: Column, tqv: Column, to3: Column, aot: Column) -> dict[str, Column]:
    """Scene scalars in the units of the correction: m/s, degrees, hPa, g/cm2, cm-atm."""
    return {"wind_speed": wind_speed(u, v), "wind_direction": wind_direction(u, v), "surface_air_pressure": ps / 100, "water_vapor": tqv / 10, "ozone": to3 / 1000, "aot550": aot}


def pack(x: Column, scale: float, fill: int = -2147483647) -> Column:
    return F.coalesce(F.rint(x / scale).cast("int"), F.lit(fill))


def unpack(x: Column, scale: float, fill: int = -2147483647) -> Column:
    return F.when(x != fill, x * scale)


#: Standard names and units by alias.
CF_NAMES = {
    "radiance_at_sensor": ("upwelling_radiance_per_unit_wavelength_in_air", "uW cm-2 nm-1 sr-1"),
    "rho_at_sensor": ("at_sensor_reflectance", "1"),
    "rho_w": ("water_leaving_reflectance", "1"),
    "rho_surface": ("surface_reflectance", "1"),
    "rho_remote_sensing": ("surface_ratio_of_upwelling_radiance_emerging_from_sea_water_to_downwelling_radiative_flux_in_air", "sr-1"),
    "F0": ("solar_irradiance_per_unit_wavelength", "W cm-2 nm-1"),
    "ndwi": ("normalized_difference_water_index", "unitless"),
    "ndvi": ("normalized_difference_vegetation_index", "unitless"),
    "s_vis_nir": ("s_vis_nir", "unitless"),
    "mask_water": ("mask_water", "boolean"),
    "sun_zenith": ("solar_zenith_angle", "degree"),
    "sun_azimuth": ("solar_azimuth_angle", "degree"),
    "view_zenith": ("sensor_zenith_angle", "degree"),
    "view_azimuth": ("sensor_azimuth_angle", "degree"),
    "relative_azimuth": ("angle_of_rotation_from_solar_azimuth_to_platform_azimuth", "degree"),
    "sample_index": ("sensor_array_index_of_across_track_samples) ", ""),
    "line_index": ("index_of_along_track_acquisition_line) ", ""),
    "wavelength": ("radiation_wavelength", "nm"),
    "time": ("time", "seconds since 1970-01-01 00:00:00"),
    "x": ("projection_x_coordinate", "m"),
    "y": ("projection_y_coordinate", "m"),
    "z": ("height", "m"),
    "lat": ("latitude", "degree_north"),
    "lon": ("longitude", "degree_east"),
    "wind_speed": ("wind_speed", "m s-1"),
    "wind_direction": ("wind_from_direction", "degree"),
    "surface_air_pressure": ("surface_air_pressure", "hPa"),
}


def cf_name(alias: Column) -> Column:
    """struct(standard_name, unit), NULL for unknown aliases."""
    pairs = [x for k, (n, u) in CF_NAMES.items() for x in (F.lit(k), F.struct(F.lit(n).alias("standard_name"), F.lit(u).alias("unit")))]
    return F.try_element_at(F.create_map(*pairs), alias)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIELab of sRGB in 0..1 (D65 white)."""
    lin = lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)
    r, g, b = lin(r), lin(g), lin(b)
    xyz = [(0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.95047, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.08883]
    x, y, z = [F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in xyz]
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def window_size(ram_gb: float, n_wavelengths: int, n_variables: int = 6, value_bytes: int = 4) -> int:
    """Side of the square window whose variables fit in memory."""
    return math.isqrt(int(ram_gb * 1024**3) // value_bytes // (n_wavelengths * n_variables))


def window_side(ram_gb: Column, n_wavelengths: int, n_variables: int = 6, value_bytes: int = 4) -> Column:
    """window_size() of a column."""
    cells = F.floor(F.floor(ram_gb * float(1024**3) / value_bytes) / (n_wavelengths * n_variables))
    return F.floor(F.sqrt(cells)).cast("long")

"""Bayesian inversion of water reflectance: MAP by damped Gauss-Newton steps, and Hamiltonian sampling.

The water column is Albert & Mobley (2003) with Bricaud-like absorption. The
bottom is a fixed mean, or a logit spectrum under a mixture of low-rank
Gaussians that is solved for with the water. With a sweep of the atmosphere by
AOD the observation is the sensor's reflectance, and the AOD is solved for too.

Spectra are independent, so the table is mapped in Arrow batches; nothing is
grouped or shuffled. A batch's spectra are solved together: every step is array
algebra with analytic derivatives over all that have not settled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prior means and deviations.
LOG_PRIORS = {"chl": (math.log(0.9), 0.6), "ag440": (math.log(0.25), 0.6), "spm": (math.log(2.0), 1.6)}
NORMAL_PRIORS = {"anap": (0.0051, 0.0012), "bbp": (0.0047, 0.0012), "s_g": (0.017, 0.0012), "s_nap": (0.006, 0.0012), "gamma": (0.65, 0.12), "h_w": (3.0, 2.0)}
#: The priors, all normal and above zero, of the model that solves for the atmosphere too, and what it holds fixed.
COUPLED_PRIORS = {"aod550": (0.10, 0.6), "chl": (1.0, 0.8), "ag440": (0.6, 1.0), "spm": (1.0, 0.9), "gamma": (0.7, 0.3), "s_g": (0.015, 0.01), "h_w": (3.0, 3.0)}
COUPLED_FIXED = {"anap": 0.0051, "bbp": 0.0047, "s_nap": 0.006}
#: Fixed value: deviation of the half-normal prior of the model's own error.
MODEL_ERROR = 5e-5
PARAMS = (*LOG_PRIORS, *NORMAL_PRIORS)
#: Fixed value: the greatest depth.
MOST_DEPTH = 30.0


@dataclass
class Optics:
    wavelength: np.ndarray
    a_w: np.ndarray
    a0: np.ndarray
    a1: np.ndarray
    bottom: np.ndarray
    bb_w: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.bb_w is None:
            self.bb_w = 0.00111 * (self.wavelength / 500) ** -4.32


@dataclass
class Sweep:
    """The atmosphere's terms by AOD (rows) and band, all else bound: see lut.sweep()."""

    aod: np.ndarray
    path: np.ndarray
    t_ra: np.ndarray
    s_ra: np.ndarray

    def at(self, aod: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(value, slope) of path, t_ra and s_ra, linear between nodes and held beyond the ends."""
        i = np.clip(np.searchsorted(self.aod, aod, "right") - 1, 0, len(self.aod) - 2)
        step = (self.aod[i + 1] - self.aod[i])[:, None]
        raw = (aod - self.aod[i])[:, None] / step
        w = np.clip(raw, 0, 1)
        inside = (raw >= 0) & (raw <= 1)
        return [(x[i] + w * (x[i + 1] - x[i]), np.where(inside, (x[i + 1] - x[i]) / step, 0.0)) for x in (self.path, self.t_ra, self.s_ra)]


def synthetic_optics(wavelength: Sequence[float]) -> Optics:
    wl = np.asarray(wavelength, float)
    return Optics(wl, 0.005 + 0.6 * np.exp((wl - 750) / 60), 0.3 + 0.7 * np.exp(-(((wl - 440) / 60) ** 2)), 0.02 * np.ones_like(wl), 0.1 + 0.1 * (wl - wl.min()) / max(1.0, np.ptp(wl)))


def optics_from_files(spark: SparkSession, folder: str, wavelengths: Sequence[float]) -> Optics:
    """Optics at a sensor's bands from three CSV files: a_w (wavelength, a_w), phyto (wavelength, a0, a1), bottom (wavelength, class, r_b_mean).

    Linear in wavelength, held at the ends; the bottom is the mean of its classes. Libraries of some thousand rows.
    """
    from ..sources.scene import read_library

    def column(df: DataFrame, name: str) -> np.ndarray:
        rows = df.groupBy("wavelength").agg(F.avg(name).alias("v")).orderBy("wavelength").collect()
        return np.interp(wavelengths, [r["wavelength"] for r in rows], [r["v"] for r in rows])

    a_w = read_library(spark, f"{folder}/a_w", ["wavelength", "a_w"])
    phyto = read_library(spark, f"{folder}/phyto", ["wavelength", "a0", "a1"])
    bottom = read_library(spark, f"{folder}/bottom", ["wavelength", "class", "r_b_mean"])
    return Optics(np.asarray(wavelengths, float), column(a_w, "a_w"), column(phyto, "a0"), column(phyto, "a1"), column(bottom, "r_b_mean"))


def _cosine(degrees: np.ndarray) -> np.ndarray:
    return np.cos(np.arcsin(np.sin(np.radians(degrees)) / 1.34))[:, None]


def water(p: Mapping[str, np.ndarray], o: Optics, sun: np.ndarray, view: np.ndarray, bottom: np.ndarray, published: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Subsurface reflectance (spectra, bands), its derivatives by parameter and by the bottom. Parameters are one value a spectrum."""
    q = {k: np.asarray(v, float)[:, None] for k, v in p.items()}
    wl = o.wavelength
    aph = 0.06 * q["chl"] ** 0.65
    log_term = o.a0 + o.a1 * np.log(aph)
    grows = log_term * aph > 0
    cdom, nap = np.exp(-q["s_g"] * (wl - 440)), np.exp(-q["s_nap"] * (wl - 440))
    scatter = (wl / 550) ** -q["gamma"]
    a = o.a_w + np.where(grows, log_term * aph, 0) + q["ag440"] * cdom + q["anap"] * q["spm"] * nap
    bb = o.bb_w + q["bbp"] * q["spm"] * scatter
    cs, cv = _cosine(sun), _cosine(view)
    e = a + bb
    w = bb / e
    c0 = 0.0512 * (1 + 0.1098 / cs) * (1 + 0.4021 / cv)
    poly, slope = 1 + 4.6659 * w - 7.8387 * w**2 + 5.4571 * w**3, 4.6659 - 15.6774 * w + 16.3713 * w**2
    deep, deep_w = c0 * poly * w, c0 * (poly + w * slope)
    kd = 1.0546 * e / cs
    ku_w = e / cv * (1 + w) ** 3.5421 * (1 - 0.2786 / cs)
    ku_b = e / cv * (1 + w) ** 2.2658 * (1 + (0.0577 if published else -0.0577) / cs)
    h = q["h_w"]
    column, floor = 1.1576 * np.exp(-h * (kd + ku_w)), 1.0389 / math.pi * np.exp(-h * (kd + ku_b))
    rrs = deep * (1 - column) + floor * bottom
    by_e = deep * column * h * (kd + ku_w) / e - floor * bottom * h * (kd + ku_b) / e
    by_w = deep_w * (1 - column) + deep * column * h * ku_w * 3.5421 / (1 + w) - floor * bottom * h * ku_b * 2.2658 / (1 + w)
    by_a, by_bb = by_e - by_w * w / e, by_e + by_w * (1 - w) / e
    d = {
        "chl": by_a * np.where(grows, (log_term + o.a1) * aph * 0.65 / q["chl"], 0), "ag440": by_a * cdom,
        "spm": by_a * q["anap"] * nap + by_bb * q["bbp"] * scatter, "anap": by_a * q["spm"] * nap, "bbp": by_bb * q["spm"] * scatter,
        "s_g": -by_a * q["ag440"] * (wl - 440) * cdom, "s_nap": -by_a * q["anap"] * q["spm"] * (wl - 440) * nap,
        "gamma": -by_bb * q["bbp"] * q["spm"] * np.log(wl / 550) * scatter, "h_w": deep * column * (kd + ku_w) - floor * bottom * (kd + ku_b),
    }
    return rrs, d, floor


def forward(p: dict[str, float], o: Optics, sun: float, view: float, published: bool = False) -> np.ndarray:
    """Subsurface reflectance of one shallow column over the mean bottom."""
    one = np.array([0.0])
    return water({k: one + v for k, v in p.items()}, o, one + sun, one + view, o.bottom[None, :], published)[0][0]


def to_sensor(rrs: np.ndarray, sweep: Sweep, aod: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sensor reflectance, and its derivatives by rrs and by AOD: path alone where the coupling breaks down."""
    under = 1 - 1.562 * rrs
    rho = math.pi * 0.518 * rrs / under
    lit = rho > 0
    rho, by_rrs = np.where(lit, rho, 0), np.where(lit, math.pi * 0.518 / under**2, 0)
    (path, path_d), (t, t_d), (s, s_d) = sweep.at(aod)
    d = 1 - s * rho
    good = d >= 1e-6
    d = np.where(good, d, 1)
    value = path + np.where(good, t * rho / d, 0)
    return value, np.where(good, t / d**2, 0) * by_rrs, path_d + np.where(good, t_d * rho / d + t * rho * rho * s_d / d**2, 0)


class Model:
    """Negative log posterior of many spectra at once over unconstrained vectors: parameters, then the logit bottom if it has a prior.

    A parameter is a smooth positive function of its place in the vector (a depth
    stays below 30 m), 0 standing for the centre of its prior and 1 for about a
    deviation. The density is that of the parameters themselves, whose mode is
    the MAP; ``jacobian`` makes it the vector's, which sampling needs.

    prior: the mixture of bottom_prior(), or a pair (mean, deviation) of logit spectra. sweep: solve for the AOD too.
    """

    def __init__(self, obs: np.ndarray, sigma: np.ndarray, optics: Optics, sun: np.ndarray, view: np.ndarray, normal: dict | None = None, prior: dict | tuple | None = None, sweep: Sweep | None = None, published: bool = False, jacobian: bool = False):
        self.jacobian = jacobian
        self.obs, self.o, self.sun, self.view, self.sweep, self.published = obs, optics, sun, view, sweep, published
        self.var = np.broadcast_to(np.square(sigma), obs.shape)
        if sweep is None:
            self.names, self.priors, self.fixed = PARAMS, LOG_PRIORS | NORMAL_PRIORS | (normal or {}), {}
        else:
            self.names, self.priors, self.fixed = tuple(COUPLED_PRIORS), COUPLED_PRIORS | (normal or {}), COUPLED_FIXED
        self.logs = set(LOG_PRIORS) if sweep is None else set()
        self.n = len(self.names)
        self.prior = None if prior is None else _components(prior)
        self.size = self.n + (len(optics.wavelength) if self.prior else 0)

    def start(self, part: int | None = None) -> np.ndarray:
        """The centre of the priors; of one part of the bottom's if one is named."""
        x = np.zeros((len(self.obs), self.size))
        if self.prior:
            x[:, self.n :] = sum(w * mu for w, mu, *_ in self.prior) if part is None else self.prior[part][1]
        return x

    def unpack(self, x: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Parameters and their slopes."""
        p, d = {}, {}
        for k, u in zip(self.names, x[:, : self.n].T):
            m, s = self.priors[k]
            if k in self.logs:
                p[k] = np.exp(np.clip(m + s * u, -12, 12))
                d[k] = np.where(np.abs(m + s * u) < 12, s * p[k], 0)
            elif k == "h_w":
                part = m / MOST_DEPTH
                v = 1 / (1 + np.exp(-np.clip(math.log(part / (1 - part)) + s / (m * (1 - part)) * u, -30, 30)))
                p[k], d[k] = MOST_DEPTH * v, MOST_DEPTH * v * (1 - v) * s / (m * (1 - part))
            else:
                p[k] = m * np.exp(np.clip(s / m * u, -12, 12))
                d[k] = np.where(np.abs(s / m * u) < 12, s / m * p[k], 0)
        return p, d

    def _scalar_prior(self, x: np.ndarray):
        """Cost of the parameters, its gradient and curvature."""
        p, d = self.unpack(x)
        cost, g, h = np.zeros(len(x)), np.zeros((len(x), self.n)), np.zeros((len(x), self.n))
        for i, k in enumerate(self.names):
            m, s = self.priors[k]
            if k in self.logs:
                u = x[:, i]
                cost += 0.5 * u * u + (0 if self.jacobian else s * u)
                g[:, i], h[:, i] = u + (0 if self.jacobian else s), 1
                continue
            r = (p[k] - m) / s
            cost += 0.5 * r * r
            g[:, i], h[:, i] = r * d[k] / s, (d[k] / s) ** 2
            if self.jacobian:
                cost -= np.log(np.maximum(d[k], 1e-300))
                share = p[k] / MOST_DEPTH if k == "h_w" else 0
                g[:, i] -= d[k] / np.maximum(p[k], 1e-300) * (1 - 2 * share) / (1 - share)
            h[:, i] = np.maximum(h[:, i], 1e-6)
        return cost, g, h

    def bottom(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, self.n :], -30, 30))) if self.prior else np.broadcast_to(self.o.bottom, self.obs.shape)

    def _predict(self, x: np.ndarray, rows: np.ndarray):
        p, slope = self.unpack(x)
        rb = self.bottom(x) if self.prior else np.broadcast_to(self.o.bottom, (len(x), len(self.o.wavelength)))
        full = p | {k: np.full(len(x), v) for k, v in self.fixed.items()}
        rrs, d, by_bottom = water(full, self.o, self.sun[rows], self.view[rows], rb, self.published)
        columns = {k: d[k] for k in self.names if k != "aod550"}
        if self.sweep is not None:
            rrs, by_rrs, by_aod = to_sensor(rrs, self.sweep, p["aod550"])
            columns = {k: v * by_rrs for k, v in columns.items()} | {"aod550": by_aod}
            by_bottom = by_bottom * by_rrs
        return rrs, np.stack([columns[k] * slope[k][:, None] for k in self.names], axis=2), by_bottom * rb * (1 - rb)

    @np.errstate(all="ignore")  # steps too far overflow and are not taken
    def evaluate(self, x: np.ndarray, rows: np.ndarray | None = None, error: np.ndarray | None = None, hessian: bool = True):
        """Value, gradient and Gauss-Newton matrix of each row's vector; ``error``: the model's own deviation."""
        rows = np.arange(len(self.obs)) if rows is None else rows
        got, j, by_eta = self._predict(x, rows)
        own = 0.0 if error is None else error[:, None] ** 2
        weight = 1 / (self.var[rows] + own)
        r = got - self.obs[rows]
        cost, prior_g, prior_h = self._scalar_prior(x)
        value = 0.5 * (r * r * weight).sum(axis=1) + cost
        if error is not None:
            value += 0.5 * np.log1p(own / self.var[rows]).sum(axis=1) + 0.5 * (error / MODEL_ERROR) ** 2
        wr = weight * r
        g = np.empty_like(x)
        g[:, : self.n] = (j * wr[:, :, None]).sum(axis=1) + prior_g
        h = None
        if hessian:
            h = np.zeros((len(x), self.size, self.size))
            h[:, : self.n, : self.n] = np.einsum("bij,bik->bjk", j * weight[:, :, None], j)
            h[:, np.arange(self.n), np.arange(self.n)] += prior_h
        if self.prior:
            k = np.arange(self.n, self.size)
            cost, slope, precision = _mixture(x[:, self.n :], self.prior, hessian)
            value = value + cost
            g[:, self.n :] = by_eta * wr + slope
            if hessian:
                cross = j * (weight * by_eta)[:, :, None]
                h[:, self.n :, : self.n], h[:, : self.n, self.n :] = cross, cross.transpose(0, 2, 1)
                h[:, self.n :, self.n :] = precision
                h[:, k, k] += weight * by_eta**2
        return value, g, h, r

    def own_error(self, r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The model's own deviation that explains residuals best, from a fixed row of steps."""
        steps = MODEL_ERROR * np.append(0, 2.0 ** np.arange(-4, 4, 0.5))
        var = self.var[rows][:, :, None] + steps**2
        cost = 0.5 * (r[:, :, None] ** 2 / var + np.log(var)).sum(axis=1) + 0.5 * (steps / MODEL_ERROR) ** 2
        return steps[cost.argmin(axis=1)]


def solve(model: Model, x: np.ndarray | None = None, iterations: int = 200, tolerance: float = 1e-6, own_error: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt on all spectra at once: vectors, values and which settled (a step that can't descend any more has not, unless the gradient is flat)."""
    x = model.start() if x is None else x.copy()
    m = len(x)
    ok, damp, error = np.zeros(m, bool), np.full(m, 1e-3), np.zeros(m) if own_error else None
    value = np.full(m, np.inf)
    live = np.arange(m)
    small, grow = np.zeros(m, int), np.full(m, 2.0)
    for _ in range(iterations):
        if not len(live):
            break
        e = error[live] if own_error else None
        f, g, h, r = model.evaluate(x[live], live, e)
        value[live] = f
        done = np.abs(g).max(axis=1) < tolerance * np.maximum(1, np.abs(f))
        done |= small[live] >= 3
        if own_error:
            error[live] = model.own_error(r, live)
            changed = error[live] != e
            done &= ~changed
            f = np.where(changed, model.evaluate(x[live], live, error[live], False)[0], f) if changed.any() else f
        ok[live[done]] = True
        stuck = ~done & (damp[live] > 1e12)
        go = ~done & ~stuck
        live, f, g, h = live[go], f[go], g[go], h[go]
        if not len(live):
            break
        h[~np.isfinite(h).all(axis=(1, 2))] = np.eye(model.size)
        k = np.arange(model.size)
        diag = h[:, k, k].copy()
        damped = h.copy()
        damped[:, k, k] = diag * (1 + damp[live][:, None])
        step = -np.linalg.solve(damped, g[:, :, None])[:, :, 0]
        trial = x[live] + step
        after = model.evaluate(trial, live, error[live] if own_error else None, False)[0]
        better = np.isfinite(after) & (after < f)
        gain = f - after
        small[live] = np.where(better & (gain <= 1e-10 * np.maximum(1, np.abs(f))), small[live] + 1, np.where(better, 0, small[live]))
        x[live[better]] = trial[better]
        value[live[better]] = after[better]
        # damping by how well the quadratic model foretold the gain (Nielsen 1999)
        foretold = 0.5 * (step * (damp[live][:, None] * diag * step - g)).sum(axis=1)
        ratio = np.clip(gain / np.maximum(foretold, 1e-300), 0, 2)
        damp[live] = np.where(better, np.maximum(damp[live] * np.maximum(1 / 3, 1 - (2 * ratio - 1) ** 3), 1e-12), damp[live] * grow[live])
        grow[live] = np.where(better, 2.0, np.minimum(grow[live] * 2, 1e6))
        lost = np.flatnonzero(~better)
        if len(lost):  # no step descends: settled if a full one has nothing to gain
            h[:, k, k] = diag * (1 + 1e-9)
            full = np.linalg.solve(h[lost], g[lost, :, None])[:, :, 0]
            flat = lost[(g[lost] * full).sum(axis=1) < 1e-7 * np.maximum(1, np.abs(f[lost]))]
            ok[live[flat]] = True
            live = np.delete(live, flat)
    return x, value, ok


def solve_stepwise(model: Model, iterations: int = 200, own_error: bool = False, widest: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """solve() under wide deviations first, each step a tenth of the last, down to the real ones: so it is led into the right valley.

    With a mixture of bottoms, once from each part of it: the best that settled.
    """
    real, best = model.var, None
    for part in range(len(model.prior)) if model.prior else (None,):
        x, wide = model.start(part), widest
        while wide**2 > real.min():
            model.var = np.maximum(real, wide**2)
            x, _, _ = solve(model, x, min(iterations, 60))
            wide /= 10
        model.var = real
        x, value, ok = solve(model, x, iterations, own_error=own_error)
        if best is not None:
            take = np.where(ok == best[2], value < best[1], ok)
            x, value, ok = np.where(take[:, None], x, best[0]), np.where(take, value, best[1]), np.where(take, ok, best[2])
        best = x, value, ok
    return best


class Posterior:
    """Model of one spectrum."""

    def __init__(self, rrs: np.ndarray, sigma: np.ndarray, optics: Optics, sun: float, view: float, normal: dict | None = None, **more):
        self.model = Model(np.asarray(rrs, float)[None, :], sigma, optics, np.array([float(sun)]), np.array([float(view)]), normal, **more)

    def unpack(self, u: np.ndarray) -> dict[str, float]:
        return {k: float(v[0]) for k, v in self.model.unpack(np.asarray(u, float)[None, :])[0].items()}

    def value(self, u: np.ndarray) -> float:
        return float(self.model.evaluate(np.asarray(u, float)[None, :], hessian=False)[0][0])

    def gradient(self, u: np.ndarray) -> np.ndarray:
        return self.model.evaluate(np.asarray(u, float)[None, :], hessian=False)[1][0]


def sample(f, g, u: np.ndarray, draws: int = 300, warmup: int = 300, chains: int = 2, seed: int = 1234, leaps: int = 12) -> np.ndarray:
    """Hamiltonian Monte Carlo with a step size adapted in warm-up."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(chains):
        x, step = u + 0.1 * rng.standard_normal(len(u)), 0.1
        for it in range(warmup + draws):
            p = rng.standard_normal(len(u))
            h0, y, q = f(x) + 0.5 * p @ p, x.copy(), p - 0.5 * step * g(x)
            for k in range(leaps):
                y = y + step * q
                if k < leaps - 1:
                    q = q - step * g(y)
            q = q - 0.5 * step * g(y)
            h1 = f(y) + 0.5 * q @ q
            ok = np.isfinite(h1) and rng.random() < math.exp(min(0.0, h0 - h1))
            x = y if ok else x
            if it < warmup:
                step *= 1.05 if ok else 0.85
            else:
                out.append(x.copy())
    return np.array(out)


def sample_all(model: Model, x: np.ndarray, draws: int = 300, warmup: int = 300, chains: int = 2, seed: int = 1234, leaps: int = 12) -> np.ndarray:
    """Posterior means of all spectra's vectors: Hamiltonian chains side by side, in the metric of each solution's Gauss-Newton matrix."""
    rng = np.random.default_rng(seed)
    _, _, h, _ = model.evaluate(x)
    h[:, np.arange(model.n), np.arange(model.n)] += 0.05  # no axis is flat
    scale = np.linalg.cholesky(np.linalg.inv(h))  # x = centre + scale z
    total = np.zeros_like(x)
    for _ in range(chains):
        z, step = 0.1 * rng.standard_normal(x.shape), np.full(len(x), 0.3)

        def at(z):
            f, g, _, _ = model.evaluate(x + np.einsum("bij,bj->bi", scale, z), hessian=False)
            return f, np.einsum("bji,bj->bi", scale, g)

        f, g = at(z)
        for it in range(warmup + draws):
            p = rng.standard_normal(x.shape)
            y, q, fy, gy = z, p - 0.5 * step[:, None] * g, f, g
            for k in range(leaps):
                y = y + step[:, None] * q
                fy, gy = at(y)
                q = q - (0.5 if k == leaps - 1 else 1) * step[:, None] * gy
            gain = f + 0.5 * (p * p).sum(axis=1) - fy - 0.5 * (q * q).sum(axis=1)
            take = np.isfinite(gain) & (np.log(rng.random(len(x))) < gain)
            z, f, g = np.where(take[:, None], y, z), np.where(take, fy, f), np.where(take[:, None], gy, g)
            if it < warmup:
                step *= np.where(take, 1.03, 0.9)
            else:
                total += x + np.einsum("bij,bj->bi", scale, z)
    return total / (draws * chains)


def invert(pixels: DataFrame, key: Sequence[str], rho: str, optics: Optics, sun: str = "sun_zenith", view: str = "view_zenith", sigma: float | str = 2e-4, method: str = "map", iterations: int = 200, draws: int = 100, prior: dict | tuple | None = None, sweep: Sweep | None = None, own_error: bool = False, most_depth: tuple[str, float] | None = None, published: bool = False, normal: dict | None = None) -> DataFrame:
    """Parameters of each spectrum: MAP, or posterior means; NULL and not ok for spectra that are not valid.

    rho is water reflectance above the surface or, with ``sweep``, sensor
    reflectance without gas. sigma: the deviation of what is compared, or a
    column of deviations by band. ``ok`` says that the solution settled. With a
    ``prior`` of the bottom its spectrum comes as ``r_b``. normal: other (mean,
    deviation) of the normal priors. most_depth: (column,
    limit) of a depth that must be finite and no deeper.
    """
    more = ([sigma] if isinstance(sigma, str) else []) + ([most_depth[0]] if most_depth else [])
    df = pixels.select(*dict.fromkeys([*key, rho, sun, view, *more]))
    names = PARAMS if sweep is None else tuple(COUPLED_PRIORS)
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{keys}, {', '.join(f'{p} double' for p in names)}, fit double, ok boolean" + (", r_b array<double>" if prior is not None else "")
    bands = len(optics.wavelength)

    def array(values) -> np.ndarray:
        return np.array([[np.nan if a is None else a for a in r] if r is not None and len(r) == bands else [np.nan] * bands for r in values], float).reshape(-1, bands)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                number = lambda c: np.array([np.nan if v is None else float(v) for v in b.column(c).to_pylist()])
                x, s, v = array(b.column(rho).to_pylist()), number(sun), number(view)
                dev = array(b.column(sigma).to_pylist()) if isinstance(sigma, str) else np.full(x.shape, float(sigma))
                valid = np.isfinite(x).all(axis=1) & (x >= 0).all(axis=1) & np.isfinite(s) & np.isfinite(v) & np.isfinite(dev).all(axis=1) & (dev > 0).all(axis=1)
                if most_depth:
                    depth = number(most_depth[0])
                    valid &= np.isfinite(depth) & (depth <= most_depth[1])
                live = np.flatnonzero(valid)
                got = {p: np.full(len(x), np.nan) for p in names}
                fit, ok, rb = np.full(len(x), np.nan), np.zeros(len(x), bool), [None] * len(x)
                if len(live):
                    obs = x[live] if sweep is not None else x[live] / math.pi / (0.52 + 1.7 * x[live] / math.pi)
                    model = Model(obs, dev[live], optics, s[live], v[live], normal, prior=prior, sweep=sweep, published=published)
                    u, f, settled = solve_stepwise(model, iterations, own_error)
                    if method == "hmc":
                        model.jacobian = True
                        u = sample_all(model, u, draws, draws)
                        f = model.evaluate(u, hessian=False)[0]
                    p, _ = model.unpack(u)
                    for k in names:
                        got[k][live] = p[k]
                    fit[live], ok[live] = f, settled
                    for i, r in zip(live, model.bottom(u) if prior is not None else ()):
                        rb[i] = r.tolist()
                null = lambda a: pa.array(a, pa.float64(), mask=np.isnan(a))
                columns = [*(b.column(k) for k in key), *(null(got[p]) for p in names), null(fit), pa.array(ok)] + ([pa.array(rb, pa.list_(pa.float64()))] if prior is not None else [])
                yield pa.RecordBatch.from_arrays(columns, names=[*key, *names, "fit", "ok"] + (["r_b"] if prior is not None else []))

    return df.mapInArrow(run, schema)


def posterior_draws(pixels: DataFrame, key: Sequence[str], rho: str, optics: Optics, sun: str = "sun_zenith", view: str = "view_zenith", sigma: float = 2e-4, chains: int = 4, draws: int = 250, warmup: int = 250, seed: int = 1234, iterations: int = 200) -> DataFrame:
    """(key, chain, draw, parameters): draws of each valid spectrum's posterior, a row a draw, for sampling.summary().

    Chains start at the spectrum's mode and move in the metric of its Gauss-Newton matrix there. Spectra that are not
    valid have no rows.
    """
    from .sampling import draw_table

    bands = len(optics.wavelength)
    valid = (F.size(rho) == bands) & F.forall(rho, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0)) & F.col(sun).isNotNull() & F.col(view).isNotNull()
    rows = pixels.select(*key, F.col(rho).cast("array<double>").alias("__rho"), F.col(sun).cast("double").alias("__sun"), F.col(view).cast("double").alias("__view")).where(F.coalesce(valid, F.lit(False)))

    def density(b: pa.RecordBatch):
        x = np.array(b.column("__rho").to_pylist(), float).reshape(-1, bands)
        model = Model(x / math.pi / (0.52 + 1.7 * x / math.pi), np.full(x.shape, float(sigma)), optics, b.column("__sun").to_numpy(), b.column("__view").to_numpy())
        mode, _, _ = solve_stepwise(model, iterations, False)
        model.jacobian = True
        _, _, h, _ = model.evaluate(mode)
        h[:, np.arange(model.n), np.arange(model.n)] += 0.05  # no axis is flat
        scale = np.linalg.cholesky(np.linalg.inv(h))

        def at(z: np.ndarray):
            f, g, _, _ = model.evaluate(mode + np.einsum("bij,bj->bi", scale, z), hessian=False)
            return f, np.einsum("bji,bj->bi", scale, g)

        at.parameters = lambda z: np.column_stack([model.unpack(mode + np.einsum("bij,bj->bi", scale, z))[0][p] for p in PARAMS])
        return at, np.zeros(mode.shape)

    return draw_table(rows, key, density, PARAMS, chains, draws, warmup, seed)


def segment_spectra(stats: DataFrame, scalars: DataFrame, wavelengths: Sequence[float], seg: str = "seg_id") -> DataFrame:
    """Segment medians and deviations as arrays in band order, joined (inner) to the segments' scalars: what invert() takes, a row a segment.

    Deviations are 1.4826 MAD; where a band has none, the median of the segment's others; in [1e-6, 0.2]. Segments that lack a band are left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct("wavelength", "rho_med", "rho_mad")))
    got = stats.groupBy(seg).agg(ordered.alias("x")).where(F.size("x") == len(wavelengths))
    mads = F.array_sort(F.filter(F.transform("x", lambda b: b["rho_mad"]), lambda m: m.isNotNull() & ~F.isnan(m)))
    n = F.size(mads)
    middle = (F.get(mads, F.floor((n - 1) / 2).cast("int")) + F.get(mads, F.floor(n / 2).cast("int"))) / 2
    limited = lambda m: F.least(F.greatest(1.4826 * F.coalesce(F.nanvl(m, F.lit(None).cast("double")), middle), F.lit(1e-6)), F.lit(0.2))
    return got.select(seg, F.transform("x", lambda b: b["rho_med"]).alias("rho"), F.transform("x", lambda b: limited(b["rho_mad"])).alias("sigma")).join(scalars, seg)


def to_raster(result: DataFrame, labels: DataFrame, seg: str = "seg_id") -> DataFrame:
    """A segment's results at each of its pixels; pixels without a segment have none."""
    return labels.join(result, seg, "left")


# --- bottom prior -------------------------------------------------------------------


def covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance; zeros for fewer than two rows."""
    x = np.atleast_2d(x)
    return np.zeros((x.shape[1], x.shape[1])) if len(x) < 2 else np.cov(x, rowvar=False, ddof=1).reshape(x.shape[1], x.shape[1])


def cholesky(c: np.ndarray, jitter: float = 1e-6, tries: int = 8) -> np.ndarray:
    for k in range(tries + 1):
        try:
            return np.linalg.cholesky(c + jitter * 10**k * np.eye(len(c)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("not positive definite")


def pca_basis(x: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    _, _, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:q].T


def bottom_prior(replicates: dict[str, np.ndarray], q: int = 8, eps: float = 1e-6) -> dict:
    """Low-rank mixture of logit bottom spectra: basis, class means, score factors, residual variances, weights."""
    logit = {k: np.log(np.clip(v, eps, 1 - eps) / (1 - np.clip(v, eps, 1 - eps))) for k, v in replicates.items()}
    stacked = np.vstack(list(logit.values()))
    mean, basis = pca_basis(stacked, min(q, *stacked.shape))
    out = {"classes": list(logit), "mean": mean, "basis": basis, "mu": [], "factor": [], "residual": [], "weight": [1 / len(logit)] * len(logit)}
    for x in logit.values():
        mu = x.mean(axis=0)
        scores = (x - mu) @ basis
        rest = (x - mu) - scores @ basis.T
        out["mu"].append(mu), out["factor"].append(cholesky(covariance(scores))), out["residual"].append(max(float((rest**2).mean()), 1e-6))
    return out


def delta_prior(mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit mean and deviation of a bottom given by its reflectance, to first order."""
    m = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(m / (1 - m)), np.maximum(sd / (m * (1 - m) + 1e-8), 1e-3)


def _components(prior: dict | tuple) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    """(weight, mean, precision, log constant) of each part of a bottom prior."""
    if isinstance(prior, tuple):
        mu, sd = prior
        return [(1.0, mu, np.diag(1 / sd**2), -np.log(sd).sum() - 0.5 * len(mu) * math.log(2 * math.pi))]
    b, out = prior["basis"], []
    for mu, l, s2, w in zip(prior["mu"], prior["factor"], prior["residual"], prior["weight"]):
        inner = np.linalg.inv(l @ l.T)
        n, q = b.shape
        log = math.log(w) - np.log(np.diag(l)).sum() - 0.5 * n * math.log(2 * math.pi) - 0.5 * (n - q) * math.log(s2)
        out.append((w, mu, b @ inner @ b.T + (np.eye(n) - b @ b.T) / s2, log))
    return out


def _mixture(eta: np.ndarray, parts: list, hessian: bool):
    """Negative log density of a mixture, its gradient, and the parts' precisions weighed by their share."""
    pulls = [(eta - mu) @ a for _, mu, a, _ in parts]
    logs = np.stack([c - 0.5 * (p * (eta - mu)).sum(axis=1) for p, (_, mu, _, c) in zip(pulls, parts)], axis=1)
    top = logs.max(axis=1)
    share = np.exp(logs - top[:, None])
    total = share.sum(axis=1)
    share /= total[:, None]
    slope = sum(share[:, k, None] * p for k, p in enumerate(pulls))
    return -(top + np.log(total)), slope, np.einsum("bk,kij->bij", share, np.stack([a for _, _, a, _ in parts])) if hessian else None


def bottom_log_density(eta: np.ndarray, prior: dict) -> float:
    """log of the mixture density of a logit spectrum: score part and orthogonal residual part."""
    return -float(_mixture(np.asarray(eta, float)[None, :], _components(prior), False)[0][0])

"""Posterior draws as a table, and their diagnostics by aggregation.

A chain is a row: chains of all spectra advance together in Arrow batches, by
Hamiltonian steps whose size each chain adapts in its warm-up to an acceptance
of 0.8 (dual averaging, Hoffman & Gelman 2014) and then keeps. Random numbers
follow from the seed, the chain's key and the step by hashing, all chains at
once, so a task run twice draws the same. Draws are rows (``draw_table``);
means, deviations, split R-hat and effective sizes are grouped sums over them
(``summary``). Where only those are asked for, ``drawn_summary`` sums each half
of a chain in the task that draws it, and no draw leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (f, g): negative log density and its gradient, of rows of parameter vectors.
Density = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
ACCEPT = 0.8
LEAPS = 8


def _mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniforms(seeds: np.ndarray, step: int, n: int) -> np.ndarray:
    """``n`` numbers inside (0, 1) for each seed at a step: SplitMix64 of the seed, the step and the place."""
    at = (np.uint64(step) * np.uint64(n) + np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mixed(_mixed(seeds)[:, None] + at[None, :]) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normals(u: np.ndarray) -> np.ndarray:
    """Standard normal numbers of an even number of uniform ones (Box and Muller 1958)."""
    half = u.shape[1] // 2
    far, turn = np.sqrt(-2 * np.log(u[:, :half])), 2 * np.pi * u[:, half:]
    return np.concatenate([far * np.cos(turn), far * np.sin(turn)], axis=1)


def hamiltonian(density: Density, x: np.ndarray, seeds: Sequence[int], draws: int, warmup: int, leaps: int = LEAPS) -> Iterator[np.ndarray]:
    """The state of every row's chain after each step that follows the warm-up. ``seeds``: a row's own."""
    n, d = x.shape
    seeds = np.asarray(seeds, np.int64).view(np.uint64)
    even = d + 1 + (d + 1) % 2
    f, g = density(x)
    step = np.full(n, 0.1)
    centre, mean_log, mean_gap = np.log(10 * step), np.zeros(n), np.zeros(n)
    for it in range(warmup + draws):
        u = uniforms(seeds, it, even + 1)
        noise = normals(u[:, :even])
        jitter = 0.8 + 0.4 / (1 + np.exp(-noise[:, d]))  # no orbit length is kept to
        p, eps = noise[:, :d], (step * jitter)[:, None]
        y, q, fy, gy = x, p - 0.5 * eps * g, f, g
        for k in range(leaps):
            y = y + eps * q
            fy, gy = density(y)
            q = q - (0.5 if k == leaps - 1 else 1.0) * eps * gy
        gain = f + 0.5 * (p * p).sum(axis=1) - fy - 0.5 * (q * q).sum(axis=1)
        gain = np.where(np.isfinite(gain), np.minimum(gain, 0.0), -np.inf)
        take = np.log(u[:, even]) < gain
        x, f, g = np.where(take[:, None], y, x), np.where(take, fy, f), np.where(take[:, None], gy, g)
        if it < warmup:
            w = 1 / (it + 11)
            mean_gap = (1 - w) * mean_gap + w * (ACCEPT - np.exp(gain))
            log_step = centre - np.sqrt(it + 1) / 0.05 * mean_gap
            keep = (it + 1) ** -0.75
            mean_log = keep * log_step + (1 - keep) * mean_log
            step = np.exp(log_step if it < warmup - 1 else mean_log)
        else:
            yield x


def _keyed(rows: DataFrame, key: Sequence[str], chains: int, seed: int) -> DataFrame:
    """A row a chain, each with a seed of its own."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("__chain")).withColumn("__seed", F.xxhash64(F.lit(seed), *key, "__chain"))


def _steps(b: pa.RecordBatch, density, draws: int, warmup: int) -> Iterator[np.ndarray]:
    """The places of a batch's chains after each step, in the coordinates that are shown."""
    f, start = density(b)
    seeds = b.column("__seed").to_numpy()
    apart = normals(uniforms(~seeds.view(np.uint64), 0, start.shape[1] + start.shape[1] % 2))[:, : start.shape[1]]
    return map(getattr(f, "parameters", lambda x: x), hamiltonian(f, start + 0.1 * apart, seeds, draws, warmup))


def _columns(rows: DataFrame, key: Sequence[str]) -> list[str]:
    return [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key]


def draw_table(rows: DataFrame, key: Sequence[str], density: Callable[[pa.RecordBatch], tuple[Density, np.ndarray]], names: Sequence[str], chains: int = 4, draws: int = 250, warmup: int = 250, seed: int = 1234, batch: int = 256) -> DataFrame:
    """(key, chain, draw, a column for each of ``names``): all chains' draws.

    ``density`` makes, of a batch of rows, their density and the places where chains start; chains of a row start apart.
    Where the density moves in other coordinates, its attribute ``parameters`` turns them into those of ``names``.
    """
    schema = ", ".join([*_columns(rows, key), "chain int, draw int", *(f"`{c}` double" for c in names)])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                for k, x in enumerate(_steps(b, density, draws, warmup)):
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), b.column("__chain").cast(pa.int32()), pa.array(np.full(len(x), k), pa.int32()), *(pa.array(x[:, j]) for j in range(len(names)))], names=[*key, "chain", "draw", *names])

    return _keyed(rows, key, chains, seed).mapInArrow(run, schema)


def drawn_summary(rows: DataFrame, key: Sequence[str], density: Callable[[pa.RecordBatch], tuple[Density, np.ndarray]], names: Sequence[str], chains: int = 4, draws: int = 250, warmup: int = 250, seed: int = 1234, batch: int = 2048) -> DataFrame:
    """summary() of draw_table()'s draws, all of them: two rows a chain and parameter leave the task, whatever the draws."""
    size = max(1, int(draws**0.5))
    ends = {k for k in range(draws) if k + 1 == draws // 2 or k + 1 == draws or (k + 1) % size == 0}
    moments = ("m", "a", "q", "runs", "of_runs", "apart")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                held, sums = [], []
                for k, x in enumerate(_steps(b, density, draws, warmup)):
                    held.append(x)
                    if k not in ends:
                        continue
                    part = np.stack(held)  # a run, or what a half has of it
                    held.clear()
                    sums.append((len(part), part.mean(axis=0), part.var(axis=0)))
                    if k + 1 not in (draws // 2, draws):
                        continue
                    m = np.array([n for n, _, _ in sums], float)[:, None, None]
                    mean, var = (np.stack([s[i] for s in sums]) for i in (1, 2))
                    whole_runs = mean[m[:, 0, 0] == size]
                    n = len(whole_runs)
                    of = whole_runs.mean(axis=0) if n else np.zeros_like(mean[0])
                    apart = ((whole_runs - of) ** 2).sum(axis=0)
                    same = np.ones_like(of)
                    got = (m.sum() * same, (m * mean).sum(axis=0) / m.sum(), (m * (var + mean * mean)).sum(axis=0), n * same, of, apart)
                    sums.clear()
                    for j, c in enumerate(names):
                        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array([c] * b.num_rows), *(pa.array(np.ascontiguousarray(g[:, j])) for g in got)], names=[*key, "parameter", *moments])

    schema = ", ".join([*_columns(rows, key), "parameter string", *(f"{c} double" for c in moments)])
    return _diagnosed(_keyed(rows, key, chains, seed).mapInArrow(run, schema), key, size)


def summary(draws: DataFrame, key: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    """(key, parameter, mean, sd, rhat, ess) of a draw table with ``n`` draws a chain.

    rhat: the split one (Gelman et al., Bayesian Data Analysis, 3rd ed.): each chain is two halves. ess: draws over the
    variance that means of runs of about sqrt(n) draws have beyond what independent draws would give, at most all.
    """
    size = max(1, int(n**0.5))
    pairs = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("v")) for c in names])
    long = draws.select(*key, "chain", F.when(F.col("draw") < n // 2, 0).otherwise(1).alias("half"), F.floor(F.col("draw") / size).alias("run"), F.inline(pairs))
    runs = long.groupBy(*key, "parameter", "chain", "half", "run").agg(F.count("v").alias("m"), F.avg("v").alias("a"), F.var_pop("v").alias("s"))
    second = F.col("m") * (F.col("s") + F.col("a") * F.col("a"))
    full = F.when(F.col("m") == size, F.col("a"))
    halves = runs.groupBy(*key, "parameter", "chain", "half").agg(F.sum("m").alias("m"), (F.sum(F.col("m") * F.col("a")) / F.sum("m")).alias("a"), F.sum(second).alias("q"), F.count(full).alias("runs"), F.coalesce(F.avg(full), F.lit(0.0)).alias("of_runs"), F.coalesce(F.var_pop(full) * F.count(full), F.lit(0.0)).alias("apart"))
    return _diagnosed(halves, key, size)


def _diagnosed(halves: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """summary() of chains' halves: m draws of mean a and sum of squares q; of its whole runs the number, the mean of means and the squares about it."""
    within = (F.col("q") - F.col("m") * F.col("a") * F.col("a")) / (F.col("m") - 1)
    out = halves.groupBy(*key, "parameter").agg(
        F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("a")) / F.sum("m")).alias("mean"), F.sum("q").alias("q"), F.avg(within).alias("w"), F.var_samp("a").alias("b"), F.avg("m").alias("each"),
        F.sum("runs").alias("runs"), F.sum("apart").alias("apart"), F.sum(F.col("runs") * F.col("of_runs")).alias("r1"), F.sum(F.col("runs") * F.col("of_runs") * F.col("of_runs")).alias("r2"),
    )
    of_runs = F.try_divide(F.col("apart") + F.greatest(F.col("r2") - F.coalesce(F.try_divide(F.col("r1") * F.col("r1"), "runs"), F.lit(0.0)), F.lit(0.0)), F.col("runs") - 1)
    var = (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
    plus = (F.col("each") - 1) / F.col("each") * F.col("w") + F.col("b")
    ess = F.least(F.col("n").cast("double"), F.try_divide(F.col("n") * var, F.lit(float(size)) * of_runs))
    return out.select(*key, "parameter", "mean", F.sqrt(var).alias("sd"), F.sqrt(F.try_divide(plus, F.col("w"))).alias("rhat"), ess.alias("ess"))

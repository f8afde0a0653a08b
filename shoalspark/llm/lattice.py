"""Embedding near-duplicates by lattice hashing (E8 cells in several tables).

Vectors are scaled to length one. Each table projects them onto eight random
orthogonal directions and scales the result; the nearest point of the E8
lattice (Conway & Sloane 1982: the better of D8 and D8 + 1/2) is the cell.
Every vector is filed under its own cell and asks in the cells next to it: the
lattice points reached by the ``probes`` minimal vectors that bring it
nearest. Members of a (label, table, cell) are verified by cosine in double
precision; a pair that meets in several tables counts where it meets first,
which both sides can tell from the vectors alone.

Equal vectors of one label are one class, compared once. Cells are compared
as matrix products, in square blocks of at most ``block`` members, dealt
apart; a block gives each member's number of links and a spanning forest, not
the pairs. Components come from distributed star rounds.

Nulls, empty and zero vectors and those that hold null or non-finite
components, and vectors with a null label, link with nothing and are kept. Only
equal labels and equal lengths are compared; a table may hold vectors of several
lengths. A repeated id counts each row as a vector of its own.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix64
from .neardup import _blocks, runs

TABLES, PROBES, SCALE, BLOCK, COSINE = 6, 3, 6.0, 1024, 0.93
_SEED = 8


@functools.cache
def directions(dim: int, tables: int) -> np.ndarray:
    """(tables, dim, 8) orthonormal columns."""
    rng = np.random.default_rng(_SEED)
    width = min(8, dim)
    out = np.zeros((tables, dim, 8))
    for t in range(tables):
        out[t, :, :width] = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    return out


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(axis=1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled to integers."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    better = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(better[:, None], a, b)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out, float)


MINIMAL = _minimal()


def _code(points: np.ndarray) -> np.ndarray:
    z = np.rint(2 * points).astype(np.int64).view(np.uint64)
    h = np.zeros(len(z), np.uint64)
    for k in range(8):
        h = mix64(h + z[:, k] + np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def cells(unit: np.ndarray, directions_: np.ndarray, probes: int, scale: float) -> np.ndarray:
    """(n, tables, 1 + probes): own cell, then the neighbouring cells that come nearest."""
    n, tables = len(unit), len(directions_)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        x = scale * (unit @ directions_[t])
        own = nearest(x)
        out[:, t, 0] = _code(own)
        if probes:
            gain = (x - own) @ MINIMAL.T  # all minimal vectors are of one length
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            for p in range(probes):
                out[:, t, 1 + p] = _code(own + MINIMAL[best[:, p]])
    return out


def _unit(embeddings: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows are usable."""
    x = np.zeros((len(embeddings), dim))
    good = np.zeros(len(embeddings), bool)
    for i, e in enumerate(embeddings.to_pylist()):
        if e is not None and len(e) == dim and None not in e:
            x[i] = e
            good[i] = True
    good &= np.isfinite(x).all(axis=1)
    x[~good] = 0
    top = np.abs(x).max(axis=1)
    good &= top > 0
    x = x / np.where(top > 0, top, 1)[:, None]  # first, so that squares neither overflow nor vanish
    size = np.sqrt((x**2).sum(axis=1))
    return x / np.where(size > 0, size, 1)[:, None], good


def _met(a: np.ndarray, b: np.ndarray, upto: int) -> np.ndarray:
    """Which pairs (row of a, row of b) meet in a table before ``upto``: cells as of cells()."""
    seen = np.zeros((len(a), len(b)), bool)
    for t in range(upto):
        own_a, own_b = a[:, t, 0], b[:, t, 0]
        for p in range(a.shape[2]):
            seen |= a[:, t, p][:, None] == own_b[None, :]
            if p:
                seen |= own_a[:, None] == b[:, t, p][None, :]
    return seen


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    raw = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    ones = raw.where(usable).withColumn("h", F.xxhash64("v", "label"))
    # classes are named by their hash, for ids may repeat
    classes = materialize(ones.groupBy("h", "v", "label").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.col("h").alias("rep"), F.size("v").alias("dim"), "*"), "vectors")

    def file(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                b = batch.filter(pa.array(sizes == dim))
                u, _ = _unit(b.column("v"), dim)
                c = cells(u, directions(dim, tables), probes, scale)
                n, width = b.num_rows, tables * (1 + probes)
                pick = pa.array(np.repeat(np.arange(n), width))
                t = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)
                asks = np.tile(np.arange(1 + probes) > 0, n * tables)
                yield pa.RecordBatch.from_arrays([b.column("label").take(pick), b.column("dim").take(pick), pa.array(t), pa.array(c.reshape(-1)), pa.array(asks), b.column("rep").take(pick)], names=["label", "dim", "t", "cell", "asks", "rep"])

    label_type = classes.schema["label"].dataType.simpleString()
    cell = ["label", "dim", "t", "cell"]
    rows = classes.select("label", "dim", "rep", "v").mapInArrow(file, f"label {label_type}, dim int, t int, cell long, asks boolean, rep long")
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("size"), F.min("asks").alias("empty")).where("size >= 2 and not empty").drop("empty")
    member = _blocks(rows.join(sizes, cell), cell, "size", "rep", block)
    keys = [*cell, "bi", "bj"]
    member = member.join(classes.select("rep", "v", "n"), "rep").select(*keys, "side", "asks", "rep", "n", "v")

    def compare(batches):
        for run in runs(batches, keys):
            m = run.num_rows
            if m < 2:
                continue
            t, dim = run.column("t")[0].as_py(), run.column("dim")[0].as_py()
            mixed = run.column("bi")[0].as_py() != run.column("bj")[0].as_py()
            u, _ = _unit(run.column("v").combine_chunks(), dim)
            asks = run.column("asks").to_numpy()
            side = run.column("side").to_numpy()
            rep, weight = run.column("rep").to_numpy(), run.column("n").to_numpy()
            hit = u @ u.T >= cosine
            hit &= rep[:, None] != rep[None, :]
            hit &= ~(asks[:, None] & asks[None, :])  # at least one of the two lives here
            if mixed:
                hit &= side[:, None] != side[None, :]
            if not hit.any():
                continue
            live = np.flatnonzero(hit.any(axis=1))
            hit = hit[np.ix_(live, live)]
            c = cells(u[live], directions(dim, tables), probes, scale)
            hit &= ~_met(c, c, t)
            # a pair that meets twice in one table (each asks in the other's cell) counts in the lesser cell
            own, here = c[:, t, 0], run.column("cell")[0].as_py()
            asked = (c[:, t, 1:, None] == own[None, None, :]).any(axis=1) if probes else np.zeros((len(live), len(live)), bool)
            twice = asked & asked.T & (own[:, None] != own[None, :])
            hit &= ~twice | (np.minimum(own[:, None], own[None, :]) == here)
            rep, weight = rep[live], weight[live]
            links = hit @ weight
            root = np.arange(len(live))
            for i in range(len(live)):
                for j in np.flatnonzero(hit[i] & (root != root[i])):
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
            hub = np.array([rep[root == r].min() for r in root])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some], pa.int64()), pa.array(hub[some], pa.int64()), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"])

    found = materialize(member.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, links long"), "links")
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(found.select("a", "b"))
    done = classes.select("h", "v", "label", "rep", "least", "n").join(degree, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    done = done.select("h", "v", "label", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    named = done.groupBy("component").agg(F.min("least").alias("component_id"))  # a component's name is its least vector id
    done = done.join(named, "component").select("h", "v", "label", "links", "component_id")
    answered = ones.join(done, ["h", "v", "label"]).select("id", "links", "component_id")
    alone = raw.where(~usable).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    return answered.unionByName(alone).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

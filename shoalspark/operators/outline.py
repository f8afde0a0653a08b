"""Outlines of labelled cells: rings of grid corners, holes kept, one set a label whatever the tiles.

A cell's side is an edge of the outline where the cell beside it has another
label. Edges run clockwise as the grid is shown (rows downward), the cell on
their right, so shells have positive and holes negative shoelace area, and all
rings of a label sum to its number of cells. Each tile chains its own edges
into paths and drops the corners on straight lines; what leaves a tile is
joined label by label, on paths, not on cells. A label's cells count as joined
by their sides only: where two touch at a corner, the rings stay apart.

The last step holds the rings of one label in a task, as the result does in one
group of rows: that grows with a label's boundary, not with its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (dx, dy) of the four directions, clockwise from "right"; a side runs along its direction.
STEP = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])
#: Of the side that runs in a direction: where the other cell is (drow, dcol), and where the side begins (dx, dy from the cell's corner).
BESIDE = ((-1, 0), (0, 1), (1, 0), (0, -1))
BEGIN = ((0, 0), (1, 0), (1, 1), (0, 1))
#: Turns, in the order in which they are tried: right, none, left.
TURNS = (1, 0, 3)


def sides(labels: np.ndarray, row0: int, col0: int) -> np.ndarray:
    """(label, x, y, direction) of the edges of a tile's cells; ``labels`` has one more cell on every side, 0 is no label."""
    own = labels[1:-1, 1:-1]
    out = []
    for d, ((dr, dc), (bx, by)) in enumerate(zip(BESIDE, BEGIN)):
        other = labels[1 + dr : labels.shape[0] - 1 + dr, 1 + dc : labels.shape[1] - 1 + dc]
        r, c = np.nonzero((own != 0) & (own != other))
        out.append(np.column_stack([own[r, c], c + col0 + bx, r + row0 + by, np.full(len(r), d)]))
    return np.vstack(out)


def followers(edges: np.ndarray) -> np.ndarray:
    """Of each edge the place of the next one, -1 if that is not here: the first turn that there is an edge for."""
    ends = edges[:, 1:3] + STEP[edges[:, 3]]
    at = {key: k for k, key in enumerate(map(tuple, edges.tolist()))}
    out = np.full(len(edges), -1)
    for k, (label, (x, y), d) in enumerate(zip(edges[:, 0].tolist(), ends.tolist(), edges[:, 3].tolist())):
        for turn in TURNS:
            nxt = at.get((label, x, y, (d + turn) % 4))
            if nxt is not None:
                out[k] = nxt
                break
    return out


def paths(edges: np.ndarray) -> list[tuple]:
    """(label, closed, first direction, last direction, xs, ys): corners only; an open path has its two ends besides."""
    nxt = followers(edges)
    first = np.ones(len(edges), bool)
    first[nxt[nxt >= 0]] = False
    seen = np.zeros(len(edges), bool)
    found = []
    for start in [*np.flatnonzero(first), *range(len(edges))]:  # open paths from their beginnings, then rings
        if seen[start]:
            continue
        chain, k = [], int(start)
        while k >= 0 and not seen[k]:
            seen[k] = True
            chain.append(k)
            k = int(nxt[k])
        e = edges[chain]
        turn = np.append(True, e[1:, 3] != e[:-1, 3])
        if k >= 0:  # closed: it came back to its start
            turn[0] = e[0, 3] != e[-1, 3]
            xs, ys = e[turn, 1], e[turn, 2]
        else:
            end = e[-1, 1:3] + STEP[e[-1, 3]]
            xs, ys = np.append(e[turn, 1], end[0]), np.append(e[turn, 2], end[1])
        found.append((int(e[0, 0]), k >= 0, int(e[0, 3]), int(e[-1, 3]), xs.tolist(), ys.tolist()))
    return found


def joined(open_paths: Sequence[tuple]) -> list[tuple[list, list]]:
    """Rings (xs, ys) of one label's open paths (first direction, last direction, xs, ys), end to beginning."""
    at = {(xs[0], ys[0], d0): k for k, (d0, _, xs, ys) in enumerate(open_paths)}
    left, rings = set(range(len(open_paths))), []
    while left:
        k = min(left)
        ring_x, ring_y, d = [], [], None
        begun = open_paths[k][0]
        while k in left:
            left.remove(k)
            d0, d1, xs, ys = open_paths[k]
            drop = 1 if d == d0 else 0  # straight on: the joint is no corner
            ring_x += xs[drop:-1]
            ring_y += ys[drop:-1]
            d = d1
            k = next(at[xs[-1], ys[-1], (d1 + t) % 4] for t in TURNS if (xs[-1], ys[-1], (d1 + t) % 4) in at)
        if d == begun:
            ring_x, ring_y = ring_x[1:], ring_y[1:]
        rings.append((ring_x, ring_y))
    return rings


def shoelace(xs: np.ndarray, ys: np.ndarray) -> float:
    return float((xs * np.roll(ys, -1) - np.roll(xs, -1) * ys).sum()) / 2


def _inside(px: float, py: float, xs: np.ndarray, ys: np.ndarray) -> bool:
    """Whether a ring goes round a point: upright sides on its right, an odd number."""
    nx, ny = np.roll(xs, -1), np.roll(ys, -1)
    return bool(((xs == nx) & (xs > px) & (np.minimum(ys, ny) < py) & (np.maximum(ys, ny) > py)).sum() % 2)


def shells(rings: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Of each ring the place of the shell it belongs to: a shell's own, a hole's the smallest shell round it."""
    area = [shoelace(x, y) for x, y in rings]
    outer = sorted((k for k, a in enumerate(area) if a > 0), key=lambda k: area[k])
    boxes = {k: (rings[k][0].min(), rings[k][0].max(), rings[k][1].min(), rings[k][1].max()) for k in outer}
    out = []
    for k, (xs, ys) in enumerate(rings):
        if area[k] > 0:
            out.append(k)
            continue
        dx, dy = int(np.sign(xs[1] - xs[0])), int(np.sign(ys[1] - ys[0]))
        px, py = xs[0] + dx / 2 - dy / 2, ys[0] + dy / 2 + dx / 2  # the middle of the cell on the right of the first side
        out.append(next((s for s in outer if area[s] > -area[k] and boxes[s][0] < px < boxes[s][1] and boxes[s][2] < py < boxes[s][3] and _inside(px, py, *rings[s])), k))
    return out


RINGS = "seg_id long, shell int, ring int, hole boolean, area double, x array<int>, y array<int>"


def rings(labels: DataFrame, tile: int = 256) -> DataFrame:
    """A row a ring: seg_id, shell (its number in the label), ring (0 the shell itself, then its holes), hole, area in cells, and its corners x (column) and y (row).

    labels: row, col, seg_id; 0 and NULL are no label, as are cells that are not there. A ring begins at its first
    corner from the top, then from the left, and does not repeat it at its end. A repeated cell counts once.
    """
    cells = labels.where("seg_id <> 0").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("seg_id").cast("long").alias("seg_id"))
    reach = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / tile).cast("int")))
    near = cells.withColumn("ty", F.explode(reach("row"))).withColumn("tx", F.explode(reach("col")))  # a cell on a tile's rim is seen by its neighbours too

    def trace(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        grid = np.zeros((tile + 2, tile + 2), np.int64)
        grid[table.column("row").to_numpy() - ty * tile + 1, table.column("col").to_numpy() - tx * tile + 1] = table.column("seg_id").to_numpy()
        found = paths(sides(grid, ty * tile, tx * tile))
        label, closed, d0, d1, xs, ys = zip(*found) if found else ((),) * 6
        ints = pa.list_(pa.int32())
        return pa.table({"seg_id": pa.array(label, pa.int64()), "closed": pa.array(closed, pa.bool_()), "d0": pa.array(d0, pa.int32()), "d1": pa.array(d1, pa.int32()), "x": pa.array(xs, ints), "y": pa.array(ys, ints)})

    def close(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        label = rows[0]["seg_id"]
        whole = [(r["x"], r["y"]) for r in rows if r["closed"]] + joined([(r["d0"], r["d1"], r["x"], r["y"]) for r in rows if not r["closed"]])
        turned = []
        for xs, ys in whole:
            k = min(range(len(xs)), key=lambda i: (ys[i], xs[i]))
            turned.append((np.array(xs[k:] + xs[:k]), np.array(ys[k:] + ys[:k])))
        turned.sort(key=lambda r: (r[1][0], r[0][0], len(r[0])))
        of = shells(turned)
        number = {s: n for n, s in enumerate(dict.fromkeys(k for k, s in enumerate(of) if k == s))}
        seen: dict[int, int] = {}
        out = []
        for k, (xs, ys) in enumerate(turned):
            area = shoelace(xs, ys)
            seen[of[k]] = seen.get(of[k], 0) + (area < 0)
            out.append((label, number[of[k]], seen[of[k]] if area < 0 else 0, area < 0, area, xs.tolist(), ys.tolist()))
        columns = list(zip(*out))
        ints = pa.list_(pa.int32())
        types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), ints, ints)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["seg_id", "shell", "ring", "hole", "area", "x", "y"])

    pieces = near.groupBy("ty", "tx").applyInArrow(trace, "seg_id long, closed boolean, d0 int, d1 int, x array<int>, y array<int>")
    return pieces.groupBy("seg_id").applyInArrow(close, RINGS)


def placed(outlines: DataFrame, affine: Sequence[float]) -> DataFrame:
    """Corners in projected coordinates; areas and orientation stay those of the grid."""
    a, b, c, d, e, f = map(float, affine)
    both = F.arrays_zip("x", "y")
    x = F.transform(both, lambda p: a * p["x"] + b * p["y"] + c)
    y = F.transform(both, lambda p: d * p["x"] + e * p["y"] + f)
    return outlines.withColumns({"x": x, "y": y})


def wkt(outlines: DataFrame) -> DataFrame:
    """(seg_id, wkt): a multipolygon a label, each polygon its shell and its holes, rings closed."""
    points = F.transform(F.arrays_zip("x", "y"), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    ring = F.concat(F.lit("("), F.array_join(F.concat(points, F.slice(points, 1, 1)), ", "), F.lit(")"))
    in_order = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    polygons = outlines.groupBy("seg_id", "shell").agg(in_order("ring", ring.alias("t")).alias("r"))
    polygons = polygons.select("seg_id", "shell", F.concat(F.lit("("), F.array_join(F.transform("r", lambda x: x["t"]), ", "), F.lit(")")).alias("t"))
    return polygons.groupBy("seg_id").agg(in_order("shell", "t").alias("p")).select("seg_id", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("p", lambda x: x["t"]), ", "), F.lit(")")).alias("wkt"))


def footprint(pixels: DataFrame, valid: str = "valid", tile: int = 256) -> DataFrame:
    """Rings round all valid cells, as those of label 1."""
    return rings(pixels.where(valid).select("row", "col", F.lit(1).alias("seg_id")), tile)

import numpy as np

from shoalspark.llm import lattice


def brute(rows, cosine=0.93):
    n = len(rows)
    deg, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unit(v):
        if v is None or None in v or len(v) != 16:
            return None
        v = np.array(v, float)
        if not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    u = [unit(v) for _, v, _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= cosine:
                deg[i] += 1
                deg[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (deg[i], find(i), find(i) == i) for i in range(n)}


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for label in (0, 1):
        for _ in range(40):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 5)):
                out.append(((base + 0.1 * rng.standard_normal(16)) * rng.uniform(0.5, 2), label))
        base = rng.standard_normal(16)
        out += [(base + 0.05 * rng.standard_normal(16), label) for _ in range(60)] + [(base, label)] * 5
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(out)]
    n = len(rows)
    v = rows[0][1]
    odd = [(None, 0), ([0.0] * 16, 0), ([float("nan")] + v[1:], 0), ([None] + v[1:], 0), (v, None), (v, 0), ([float("inf")] + v[1:], 0), ([1e-200 * x for x in v], 0), (v[:3], 0), ([], 1)]
    return rows + [(n + k, a, b) for k, (a, b) in enumerate(odd)]


def test_as_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as t").repartition(3)
    want = brute(rows)
    for block in (1024, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df, block=block).collect()}
        links, found = sum(x[0] for x in want.values()), sum(x[0] for x in got.values())
        assert set(got) == set(want) and found <= links and found >= 0.97 * links
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_points_are_in_the_lattice_and_nearest():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8)) * 3
    p = lattice.nearest(x)
    twice = np.rint(2 * p).astype(int)
    assert (2 * p == twice).all() and (twice.sum(axis=1) % 4 == 0).all()
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all()
    d = ((x - p) ** 2).sum(axis=1)
    for m in lattice.MINIMAL:
        assert (((x - p - m) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert len(np.unique(lattice.MINIMAL, axis=0)) == 240


def test_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_several_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0], 0), (3, [1.0, 2.0, 3.0], 0), (2, [5.0, -1.0, 0.0], 0), (4, [], 0), (5, [1.0, 2.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (5, 0, 5, True)]

import random

import pytest

from shoalspark.llm.common import components


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_components_near_and_far(spark, bound):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), local_edges=bound).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "a long, b long"), local_edges=bound).count() == 0

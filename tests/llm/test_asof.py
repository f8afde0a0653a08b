import random

import pytest
from pyspark.sql import functions as F

from shoalspark.llm import asof

H = asof.HOUR


def brute(probes, orders, tolerance):
    once = {}
    for i, k, t in probes:
        a, b = once.get(i, (None, None))
        once[i] = (k if a is None else a if k is None else min(a, k), t if b is None else b if t is None else min(b, t))
    out = set()
    for i, (k, t) in once.items():
        near = [o for o in orders if k is not None and t is not None and o[0] == k and o[1] is not None and 0 <= t - o[1] <= tolerance]
        if not near:
            out.add((i, k, t, None, None, None, None, 0))
            continue
        at = max(o[1] for o in near)
        tied = [o for o in near if o[1] == at]
        best = max(tied, key=lambda o: (o[3] is not None, o[3] or 0, o[2] is not None, -(o[2] or 0), o[4] is not None, o[4] or 0))
        out.add((i, k, t, at, best[4], best[3], best[2], len(tied)))
    return out


def tables(spark, probes, orders):
    p = spark.createDataFrame(probes, "pid long, k long, t long").withColumn("n_tied", F.lit("clash")).withColumn("at", F.lit(1.5)).repartition(3)
    o = spark.createDataFrame(orders, "k long, at long, sid long, prio long, v long").withColumn("t", F.lit("clash")).repartition(3)
    return p, o


def joined(p, o, **more):
    got = asof.join(p, o, key="k", probe_id="pid", probe_time="t", time="at", rank=(("prio", True), ("sid", False)), values=("v",), **more)
    return got.select("pid", "k", "t", "at", "v", "prio", "sid", "n_tied")


def made(n, seed):
    """One key with a third of the rows, ties on either side, nulls, copies, times on both sides of zero."""
    rng = random.Random(seed)
    key = lambda: rng.choice([7] * 5 + [None] + list(range(9)))
    time = lambda: rng.choice([None] + [rng.randrange(-3 * 24 * H, 9 * 24 * H)] * 6 + [rng.randrange(-3, 9) * 24 * H] * 6)
    probes = [(i, key(), time()) for i in range(n)]
    probes += probes[::7] + [(3, 5, None), (4, None, 0)]
    orders = [(key(), time(), rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, 1, 2, 2]), rng.choice([None, rng.randrange(9)])) for _ in range(n)]
    return probes, orders + orders[::5]


@pytest.mark.parametrize("crowd", [10_000, 40, 3])
def test_as_brute_force(spark, crowd):
    probes, orders = made(700, crowd)
    for tolerance in (72 * H, 5 * H, 0):
        got = joined(*tables(spark, probes, orders), tolerance=tolerance, crowd=crowd, cell=100)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len({p[0] for p in probes}) and set(rows) == brute(probes, orders, tolerance)


def test_a_crowded_instant_and_a_long_gap(spark):
    """All rows of one key: most at one instant, the only order days before, in chunks of a single row."""
    day = 24 * H
    probes = [(i, 1, 3 * day) for i in range(300)] + [(300 + i, 1, 3 * day + i) for i in range(50)] + [(900, 1, 3 * day + 1000 * H)]
    orders = [(1, 5, 1, 1, 1)] * 40 + [(1, 3 * day + 20, 2, 1, 2)]
    got = {tuple(r) for r in joined(*tables(spark, probes, orders), tolerance=72 * H, crowd=2, cell=10).collect()}
    assert got == brute(probes, orders, 72 * H) and sum(r[-1] == 40 for r in got) == 300 + 6


def test_empty_sides(spark):
    p, o = tables(spark, [(1, 1, 1)], [(1, 1, 1, 1, 1)])
    assert joined(p.limit(0), o).count() == 0
    assert [tuple(r) for r in joined(p, o.limit(0)).collect()] == [(1, 1, 1, None, None, None, None, 0)]
    with pytest.raises(ValueError):
        asof.join(p, o, key="k", probe_id="pid", probe_time="t", time="t", rank=())


def test_times_without_a_zone_are_utc(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:01.123456' a, timestamp'1970-01-02 00:00:00Z' b union all select timestamp_ntz'1969-12-31 23:59:59.999999', null union all select null, null")
    got = df.select(asof.micros(df, "a").alias("a"), asof.micros(df, "b").alias("b"), asof.floored(asof.micros(df, "a"), F.lit(True), 24 * H).alias("f")).collect()
    assert [tuple(r) for r in got] == [(1710037801123456, 24 * H, 1710028800000000), (-1, None, -24 * H), (None, None, None)]

"""Tolerant as-of join: the latest order at or before a probe's time, no older than the tolerance, of the same key.

Orders of one key and time are collapsed to the one of highest rank and their
number, probes to the different (key, time) pairs. Both are then cogrouped in
cells: a key is one unit of a cell, but a key of many rows is split into time
chunks, a unit each, and a crowded day of it into several. pandas.merge_asof
joins a cell, backward and with the tolerance, unit by unit.

A chunk sees what lies before it through a halo: of all orders of the
tolerance before its start only the latest can be matched, so the halo of a
chunk is that one row. Whatever the skew, a cell holds bounded rows, and
nothing but the (key, day) pairs of crowded keys is joined by a side table,
which Spark sends or shuffles by its own size check.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, reachable

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Rows of a key from which it is split by time, and of a day from which the day is split.
CROWD = 10_000
#: Rows of a cell, about.
CELL = 50_000
#: The chunk of keys that are not split.
WHOLE = -(1 << 63)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(c)
    day = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.extract(F.lit("SECOND"), c) * 1_000_000
    return day * DAY + F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * (HOUR // 60) + seconds.cast("long")


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division, downward."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def floored(us: Column, where: Column, width: int) -> Column:
    """``us``, moved down to a multiple of ``width`` where the condition holds."""
    return F.when(where, us - F.pmod(us, F.lit(width))).otherwise(us)


def collapsed(orders: DataFrame, key: str, time: str, rank: Sequence[tuple[str, bool]], values: Sequence[str]) -> DataFrame:
    """One row a (key, time): the columns of its first order by rank, and n_tied. Rows without key or time go.

    rank: (integer column, whether the larger one wins), in order; a null loses. What is left equal is settled by
    the largest values, so repeated rows count in n_tied and change nothing else.
    """
    named = [c for c, _ in rank]
    by = [(F.col(c) if up else F.bitwise_not(F.col(c))).alias(f"r{k}") for k, (c, up) in enumerate(rank)]
    kept = list(dict.fromkeys([*values, *named]))
    best = F.max(F.struct(*by, *[F.col(c).alias(f"v{k}") for k, c in enumerate(kept)])).alias("__b")
    out = orders.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(best, F.count("*").alias("n_tied"))
    return out.select(key, time, *[F.col(f"__b.v{k}").alias(c) for k, c in enumerate(kept)], "n_tied")


def _days(probes: DataFrame, orders: DataFrame, key: str, crowd: int) -> DataFrame:
    """(key, day, parts) of the keys of more than ``crowd`` rows: into how many chunks a day is cut."""
    day = lambda df: df.select(key, _div(F.col("__t"), DAY).alias("__day"))
    both = day(probes).unionByName(day(orders)).groupBy(key, "__day").agg(F.count("*").alias("__n"))
    crowded = both.groupBy(key).agg(F.sum("__n").alias("__all")).where(F.col("__all") > crowd).select(key)
    return both.join(crowded, key, "left_semi").select(key, "__day", F.ceil(F.col("__n") / crowd).cast("int").alias("__parts"))


def _halo(orders: DataFrame, days: DataFrame, key: str, cols: Sequence[str], tolerance: int) -> DataFrame:
    """For every chunk the latest order before its start, of the same or of the days before within the tolerance."""
    row = F.struct("__t", *cols)
    last = orders.groupBy(key, "__day", "__part").agg(F.max(row).alias("__last"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(math.ceil(tolerance / DAY)))).alias("__k")
    before = last.groupBy(key, "__day").agg(F.max("__last").alias("__last")).select(key, "__day", "__last", ahead)
    before = before.groupBy(key, (F.col("__day") + F.col("__k")).alias("__day")).agg(F.max("__last").alias("__before"))
    chunks = days.select(key, "__day", "__parts", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    chunks = chunks.join(last, [key, "__day", "__part"], "left").join(before, [key, "__day"], "left")
    earlier = Window.partitionBy(key, "__day").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.last("__last", ignorenulls=True).over(earlier), "__before").alias("__h")
    return chunks.select(key, _start().alias("__chunk"), seen).where("__h is not null").select(key, "__chunk", "__h.*")


def _start() -> Column:
    return F.col("__day") * DAY + _div(F.col("__part") * F.lit(DAY), F.col("__parts").cast("long"))


def _split(df: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """``df`` with the day, part and chunk of its rows; of keys that are not split these are null and WHOLE."""
    day = df.withColumn("__day", _div(F.col("__t"), DAY)).join(days, [key, "__day"], "left")
    # the largest part whose start, rounded down as in _start(), is at or before the time
    part = _div(F.pmod(F.col("__t"), F.lit(DAY)) * F.col("__parts") + F.col("__parts") - 1, DAY)
    return day.withColumn("__part", part.cast("int")).withColumn("__chunk", F.coalesce(_start(), F.lit(WHOLE)))


def join(probes: DataFrame, orders: DataFrame, key: str, probe_id: str, probe_time: str, time: str, rank: Sequence[tuple[str, bool]], values: Sequence[str] = (), tolerance: int = 72 * HOUR, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """One row a different probe_id: id, key, time, and of its match the time, the values and rank columns, and n_tied.

    Times are integers. Copies of a probe count once; should they differ, the least key and the least time hold,
    each by itself. n_tied is the number of the key's orders at the matched time, 0 where none is matched: no
    order in reach, or a null key or time, which never match. Probes with a null id are copies of one another.
    Other columns of either side, whatever their names, are left out.
    """
    cols = [*dict.fromkeys([*values, *[c for c, _ in rank]]), "n_tied"]
    if len({probe_id, key, probe_time, time, *cols}) != 4 + len(cols):
        raise ValueError("columns of the result must have different names")
    reachable(probes.sparkSession)
    session = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = materialize(probes.groupBy(probe_id).agg(F.min(key).alias(key), F.min(probe_time).alias(probe_time)), "probes")
    right = collapsed(orders, key, time, rank, values).withColumnRenamed(time, "__t")
    right = materialize(right, "orders")
    whole = F.col(key).isNotNull() & F.col(probe_time).isNotNull()
    left = once.where(whole).select(key, F.col(probe_time).alias("__t")).distinct()
    days = materialize(_days(once.where(whole).select(key, F.col(probe_time).alias("__t")), right, key, crowd), "crowded-days")
    cells = max(4 * session, (once.count() + right.count()) // cell)
    if days.isEmpty():
        left, right = (df.withColumn("__chunk", F.lit(WHOLE)) for df in (left, right))
    else:
        left, right = _split(left, days, key), _split(right, days, key)
        halo = _halo(right.where(F.col("__chunk") != WHOLE), days, key, cols, tolerance)
        right = right.select(key, "__chunk", "__t", *cols).unionByName(halo.select(key, "__chunk", "__t", *cols))
    place = F.pmod(F.xxhash64(key, "__chunk"), F.lit(cells)).alias("__cell")
    left = left.select(place, key, "__chunk", "__t").groupBy("__cell")
    right_cells = right.select(place, key, "__chunk", "__t", *cols).groupBy("__cell")
    types = {f.name: f.dataType.simpleString() for f in [*once.schema, *right.schema]}
    schema = ", ".join([f"`{key}` {types[key]}", "__t long", f"`{time}` long", *(f"`{c}` {types[c]}" for c in cols)])

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        frame = lambda t: pd.DataFrame({"key": t.column(key).to_pandas(), "chunk": t.column("__chunk").to_numpy(), "t": t.column("__t").to_numpy(), "at": np.arange(len(t))}).sort_values("t", kind="stable")
        got = pd.merge_asof(frame(a), frame(b), on="t", by=["key", "chunk"], tolerance=tolerance, suffixes=("", "_order")).dropna(subset=["at_order"])
        probe, order = (pa.array(got[c].to_numpy().astype(np.int64)) for c in ("at", "at_order"))
        a, b = a.take(probe), b.take(order)
        return pa.table([a.column(key), a.column("__t"), b.column("__t"), *(b.column(c) for c in cols)], names=[key, "__t", time, *cols])

    found = left.cogroup(right_cells).applyInArrow(match, schema)
    hit = once.where(whole).join(found.withColumnRenamed("__t", probe_time), [key, probe_time], "left")
    none = [F.lit(None).cast(types.get(c, "long")).alias(c) for c in (time, *cols)]
    both = hit.select(probe_id, key, probe_time, time, *cols).unionByName(once.where(~whole).select(probe_id, key, probe_time, *none))
    return both.withColumn("n_tied", F.coalesce("n_tied", F.lit(0)).cast("long"))

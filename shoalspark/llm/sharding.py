"""Shards of equal bytes, tokens and rows by vector bin packing; equal texts stay together.

Rows of one text are a group, a vector of (bytes, tokens, rows). A group goes
to the shard where the dot product of its vector with what the shard still has
room for is highest, among the shards whose room for bytes is within the
group's own size of the most there is; groups come in falling order of bytes.
So bytes come out near equal, and tokens and rows as equal as that allows.

Groups that weigh 1/64 of a shard or more (a few thousand at any input size)
are packed first, on the driver. All others are dealt by hash into buckets of
some thousand groups, each of which gets its part of the room that is left and
packs its groups in a task. A group that outweighs a shard is cut by row into
as few parts as fit: keeping it whole and equal shards exclude each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, reachable

#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: Groups of 1/HEAVY of a shard are packed one by one on the driver: 3 * HEAVY * shards of them at most.
HEAVY = 64
#: Groups of a bucket, about.
BUCKET = 5_000
#: Most of a shard that a part of a cut group takes.
FULL = 0.9
#: Shards with this part of their room less than the freest one are still candidates, however small the group.
SLACK = 0.001
#: Most parts of a shard that are numbered by themselves.
PARTS = 1024
WEIGHTS = ("size", "tokens", "n")


def pack(weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item; ``room`` (shard by dimension) is used up. Both are in parts of a shard's fair share."""
    out = np.empty(len(weights), np.int32)
    slack = SLACK * max(float(room[:, 0].mean()), 0.0)
    for i in np.argsort(-weights[:, 0], kind="stable"):
        w, free = weights[i], room[:, 0]
        score = room @ w
        score[free < free.max() - max(w[0], slack)] = -np.inf
        out[i] = k = int(score.argmax())
        room[k] -= w
    return out


def _groups(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("__key", *by).agg(F.sum("__size").alias("size"), F.sum("__tokens").alias("tokens"), F.count("*").alias("n"))


def _shares(total, shards: int) -> list[float]:
    return [max(float(total[c] or 0), 1.0) / shards for c in WEIGHTS]


def _place_heavy(rows: DataFrame, groups: DataFrame, shares: Sequence[float], shards: int) -> tuple[DataFrame, np.ndarray]:
    """(key, shards of its parts) of the heavy groups, and the room left. Bounded: see HEAVY."""
    spark = rows.sparkSession
    ratio = F.greatest(*[F.col(c) / s for c, s in zip(WEIGHTS, shares)])
    heavy = groups.where(ratio >= 1 / HEAVY).select("__key", F.ceil(F.when(ratio > 1, ratio / FULL).otherwise(1)).cast("int").alias("__of"), *WEIGHTS).orderBy("__key").collect()
    cut = spark.createDataFrame([(bytes(g["__key"]), g["__of"]) for g in heavy if g["__of"] > 1], "__key binary, __of int")
    items = [(bytes(g["__key"]), 0, 1, *(g[c] for c in WEIGHTS)) for g in heavy if g["__of"] == 1]
    if not cut.isEmpty():
        parts = rows.join(F.broadcast(cut), "__key").withColumn("__part", _part())  # at most 3 * shards rows
        items += [(bytes(g["__key"]), g["__part"], g["__of"], *(g[c] for c in WEIGHTS)) for g in _groups(parts, "__part", "__of").orderBy("__key", "__part").collect()]
    room = np.ones((shards, 3))
    chosen = pack(np.array([x[3:] for x in items], float).reshape(-1, 3) / shares, room)
    places: dict[bytes, dict[int, int]] = {}
    for (key, part, _, *_), shard in zip(items, chosen):
        places.setdefault(key, {})[part] = int(shard)
    sizes = {key: of for key, _, of, *_ in items}
    table = [(key, [at.get(p, 0) for p in range(sizes[key])]) for key, at in places.items()]
    return spark.createDataFrame(table, "__key binary, __shards array<int>"), room


def _part():
    return F.pmod(F.xxhash64("__row"), F.col("__of")).cast("int")


def _place_light(groups: DataFrame, room: np.ndarray, total, shares: Sequence[float], shards: int, bucket: int) -> DataFrame:
    """(key, shard) of all other groups, bucket by bucket."""
    light = groups.where(F.greatest(*[F.col(c) / s for c, s in zip(WEIGHTS, shares)]) < 1 / HEAVY)
    n = math.ceil(total["groups"] / bucket)
    room = np.maximum(room, 0)
    left = room / np.maximum(room.sum(0), 1e-12)  # of each dimension, each shard's part of the room

    def run(table: pa.Table) -> pa.Table:
        weights = np.column_stack([table.column(c).to_numpy() for c in WEIGHTS]) / shares
        order = np.argsort(np.array(table.column("__key").to_pylist(), object))  # the same outcome whatever the order of rows
        chosen = np.empty(len(order), np.int32)
        chosen[order] = pack(weights[order], left * weights.sum(0))
        return pa.table([table.column("__key"), pa.array(chosen)], names=["__key", "__shard"])

    dealt = light.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(max(n, 1))))
    return dealt.groupBy("__bucket").applyInArrow(run, "__key binary, __shard int")


def assign(docs: DataFrame, shards: int = 40, text_col: str = "text", keep: Sequence[str] = ("doc_id",), bucket: int = BUCKET) -> DataFrame:
    """Columns ``keep`` with size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in each shard) and grown_shard (null).

    Every row gets a shard, repeated rows and rows without text too: null is a text of its own, of no bytes. Equal
    texts share a shard, unless they outweigh one. An empty table gives no rows. The added columns replace kept ones
    of their names; with the text among ``keep``, write() stores the shards.
    """
    reachable(docs.sparkSession)
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in keep if c not in made]
    text = F.col(f"`{text_col}`").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__row"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("__key"),
        (F.octet_length(raw).cast("long") + OVERHEAD).alias("__size"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("__tokens"), F.crc32(raw).alias("__crc"),
    )
    rows = materialize(rows, "rows")
    groups = materialize(_groups(rows), "groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in WEIGHTS], F.count("*").alias("groups")).first()
    shares = _shares(total, shards)
    heavy, room = _place_heavy(rows, groups, shares, shards)
    light = _place_light(groups, room, total, shares, shards, bucket)
    met = rows.join(F.broadcast(heavy), "__key", "left").withColumn("__of", F.size("__shards"))  # see HEAVY
    placed = met.where("__shards is not null").withColumn("__shard", F.get("__shards", _part())).drop("__of", "__shards")
    rest = met.where("__shards is null").drop("__of", "__shards").join(light, "__key")
    return numbered(placed.unionByName(rest).drop("__key", "__tokens"), keep, int(total["n"] or 0), shards)


def numbered(rows: DataFrame, keep: Sequence[str], n: int, shards: int) -> DataFrame:
    """Slots: rows of a shard are numbered in parts, each moved by the rows of the parts before it."""
    parts = min(PARTS, max(16, n // (shards * 50_000)))
    rows = materialize(rows.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts))), "placed")
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__shard", "__part").agg(F.count("*").alias("c"))
    moved = counts.select("__shard", "__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("__shard", "__part").orderBy("__row"))
    out = rows.withColumn("__own", own).join(F.broadcast(moved), ["__shard", "__part"])  # shards * PARTS rows at most
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").cast("int").alias("shard"), (F.col("__first") + F.col("__own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write(assigned: DataFrame, path: str, slots_per_file: int = 100_000) -> None:
    """What assign() kept, as Parquet files of at most ``slots_per_file`` rows in the order of their slots, in a folder a shard."""
    run = F.floor(F.col("slot") / slots_per_file)
    assigned.repartition("shard", run).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", slots_per_file).partitionBy("shard").parquet(path)

"""Shared helpers: table access, shared scratch space, text hashing, components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1


#: Bytes of an Arrow batch, where the session has its engine's default of 64 MB: texts are many times a row's usual size,
#: and a batch lies in memory several times over, in the JVM and in the worker.
BATCH = "8MB"


def reachable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver has it, and keep their batches small.

    On a cluster of several machines the package has to be installed there or sent along (--py-files).
    """
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.isModifiable(limit) and spark.conf.get(limit) in ("67108864b", "64MB", "64m"):
        spark.conf.set(limit, BATCH)


def tidy(batches):
    """The batches, and what the worker no longer uses back to the machine at the end: workers live on between stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in far fewer pieces than there are cores is dealt over them before anything dear runs on it."""
    reachable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def scratch(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shoalspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written for the time being."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_count_partitions(spark: SparkSession, n_bytes: float, per: float = 32e6) -> int:
    """Partitions that follow the input: never fewer than the session's, else ``n_bytes / per``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // per) + 1)


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns; extra columns, whatever their names, go."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def binary_list(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit words that spreads low entropy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class TokenHashes(dict):
    """Token bytes to a place in ``hash``, their 64-bit hashes, the same in every process; forgets all when full."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit
        self.hash = np.empty(1 << 12, U64)

    def __missing__(self, token: bytes) -> int:
        import xxhash

        k = self[token] = len(self)
        if k == len(self.hash):
            self.hash = np.concatenate([self.hash, np.empty_like(self.hash)])
        self.hash[k] = xxhash.xxh3_64_intdigest(token)
        return k

    def places(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def array(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        at = self.places(tokens)  # first: it may move the hashes
        return self.hash[at]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One order-dependent 64-bit hash for every run of ``n`` token hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out = mix64(out + h[j : j + m] + U64((j + 1) * 0x9E3779B97F4A7C15 & _MASK))
    return out


LOCAL_EDGES = 1 << 20


def _union(batches):
    """One task's union-find over all edges: (node, component)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest id reachable, for every node of an edge.

    Up to ``local_edges`` distinct edges (they are counted first; 16 MB) are
    joined by union-find in one task on an executor: rounds of shuffles would
    cost more than they spread. Beyond it, the same answer comes from alternating
    large-star and small-star rounds (Kiveris et al. 2014), each a pair of
    map-side-combined minima and a join; lineage is cut by checkpoint()
    every round. Ends when a round leaves the edges as they were.
    """
    spark = edges.sparkSession
    scratch(spark)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if e.count() <= local_edges:
        return e.coalesce(1).mapInArrow(_union, "node long, component long")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
            out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            low = e.groupBy("u").agg(F.min("v").alias("m"))
            joined = e.join(low, "u")
            out = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    before = mark(e)
    for _ in range(max_rounds):
        e = star(star(e, True), False).checkpoint()
        now = mark(e)
        if tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

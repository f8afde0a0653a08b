"""Multilinear look-up tables as node tables.

A table has named axes and outputs; nodes are rows with one index column per
axis. Axes that are constant over a scene are collapsed first (``bind``), which
leaves the axes that vary by pixel; a pixel then meets the 2^k corners of its
cell by equi-join on the axis indices. Multilinear interpolation is separable,
so the result is that of the full table.

Units are part of the specification: an axis carries the unit its values are in.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spectral import literal_interp

#: The axes of the aerosol and the gas table, in order.
AEROSOL_AXES = ("sun_zenith", "view_zenith", "relative_azimuth", "aot550", "pressure", "altitude")
GAS_AXES = ("sun_zenith", "view_zenith", "relative_azimuth", "water", "ozone", "pressure", "altitude")
PIXEL_AXES = ("sun_zenith", "view_zenith", "relative_azimuth")


@dataclass(frozen=True)
class LutSpec:
    axes: Mapping[str, Sequence[float]]
    outputs: Sequence[str]
    units: Mapping[str, str] | None = None

    def grid(self, spark: SparkSession) -> DataFrame:
        """All nodes, index and value of each axis: one range read in mixed radix, no join."""
        out, stride = spark.range(math.prod(len(v) for v in self.axes.values())), 1
        for name, values in reversed(self.axes.items()):
            i = (F.floor(F.col("id") / stride) % len(values)).cast("int")
            out = out.withColumns({f"i_{name}": i, name: F.get(F.array(*[F.lit(float(v)) for v in values]), i)})
            stride *= len(values)
        return out.drop("id")


def bracket(x: Column, axis: Sequence[float]) -> tuple[Column, Column]:
    """Lower index and weight of the upper node; NULL outside the axis. A single node holds everywhere."""
    v = [float(a) for a in axis]
    if len(v) == 1:
        return F.lit(0), F.lit(0.0)
    i, w = F.lit(None).cast("int"), F.lit(None).cast("double")
    for k in range(len(v) - 1):
        inside = (x >= v[k]) & (x <= v[k + 1])
        i, w = F.when(inside, k).otherwise(i), F.when(inside, (x - v[k]) / (v[k + 1] - v[k])).otherwise(w)
    return i, w


def _weights(axis: Sequence[float], x: float) -> dict[int, float]:
    if len(axis) == 1:
        return {0: 1.0}
    if not axis[0] <= x <= axis[-1]:
        return {}
    k = min(max(bisect.bisect_right(axis, x) - 1, 0), len(axis) - 2)
    w = (x - axis[k]) / (axis[k + 1] - axis[k])
    return {j: v for j, v in ((k, 1 - w), (k + 1, w)) if v}


def bind(nodes: DataFrame, spec: LutSpec, scene: Mapping[str, float]) -> tuple[DataFrame, LutSpec]:
    """Collapse the axes of ``scene``: read only the nodes that bracket its values, and sum them by weight.

    Outside an axis nothing is left, so later look-ups are NULL.
    """
    left = [a for a in spec.axes if a not in scene]
    weight, keep = F.lit(1.0), F.lit(True)
    for a, x in scene.items():
        w = _weights(list(map(float, spec.axes[a])), float(x))
        m = F.lit(0.0)
        for k, v in w.items():
            m = F.when(F.col(f"i_{a}") == k, v).otherwise(m)
        weight, keep = weight * m, keep & (F.col(f"i_{a}").isin(list(w)) if w else F.lit(False))
    extra = [c for c in ("wl_idx", "wavelength") if c in nodes.columns]
    out = nodes.where(keep).groupBy(*[f"i_{a}" for a in left], *extra).agg(*[F.sum(weight * F.col(o)).alias(o) for o in spec.outputs])
    return out, LutSpec({a: spec.axes[a] for a in left}, spec.outputs, spec.units)


def lookup(df: DataFrame, nodes: DataFrame, spec: LutSpec, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Outputs at each row's axis values: corners by equi-join, weighted sum by ``key`` (and band, if nodes have one).

    The node table of a bound spec is small; whether it is sent to all tasks is left to the optimizer's own size check.
    """
    extra = [c for c in ("wl_idx", "wavelength") if c in nodes.columns]
    d = df.select(*dict.fromkeys([*key, *keep, *spec.axes]))
    for a, values in spec.axes.items():
        i, w = bracket(F.col(a), values)
        d = d.withColumns({f"__i_{a}": i, f"__w_{a}": w})
    corners = F.array(*[F.struct(*[F.lit(b).alias(a) for a, b in zip(spec.axes, bits)]) for bits in itertools.product((0, 1), repeat=len(spec.axes))])
    d = d.withColumn("__k", F.explode(corners))
    weight = F.lit(1.0)
    for a in spec.axes:
        weight = weight * F.when(F.col(f"__k.{a}") == 1, F.col(f"__w_{a}")).otherwise(1 - F.col(f"__w_{a}"))
        d = d.withColumn(f"i_{a}", F.col(f"__i_{a}") + F.col(f"__k.{a}"))
    d = d.withColumn("__weight", weight).where("__weight > 0").drop("__k", *[f"__i_{a}" for a in spec.axes], *[f"__w_{a}" for a in spec.axes])
    hit = d.join(nodes, [f"i_{a}" for a in spec.axes])
    group = list(dict.fromkeys([*key, *keep, *extra]))
    return hit.groupBy(*group).agg(*[F.sum(F.col("__weight") * F.col(o)).alias(o) for o in spec.outputs])


TABLE_BYTES = 64 << 20


def place(spec: LutSpec) -> Column:
    """A node's place: its indices in mixed radix."""
    out, stride = F.lit(0), 1
    for a, v in reversed(spec.axes.items()):
        out, stride = out + F.col(f"i_{a}") * stride, stride * len(v)
    return out


def by_band(nodes: DataFrame, spec: LutSpec) -> DataFrame:
    """One row a node, ``b``: its outputs as an array of structs by band."""
    return nodes.groupBy(*[f"i_{a}" for a in spec.axes]).agg(F.array_sort(F.collect_list(F.struct("wl_idx", *spec.outputs))).alias("b"))


def _in_order(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (__place, node) as one row (for each of ``by``): ``table``, the nodes by place."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__place", "node"))).alias("t")).select(*by, F.transform("t", lambda x: x["node"]).alias("table"))


def packed(nodes: DataFrame, spec: LutSpec) -> DataFrame:
    """One row, ``table``: an array of structs of the outputs' arrays by band, at each node's place in mixed radix."""
    rows = by_band(nodes, spec).select(place(spec).alias("__place"), F.struct(*[F.col(f"b.{o}").alias(o) for o in spec.outputs]).alias("node"))
    return _in_order(rows)


def lookup_arrays(df: DataFrame, nodes: DataFrame, spec: LutSpec) -> DataFrame:
    """``df`` with an array by band of each output at its axis values; NULL outside an axis.

    One projection: the whole bound table is one row that goes to all tasks, which is refused above TABLE_BYTES (the
    nodes are counted first, all of them must be there). Nothing of ``df`` is shuffled, exploded or joined back.
    """
    n, bands = nodes.agg(F.count("*"), F.count_distinct("wl_idx")).first()
    size = math.prod(len(v) for v in spec.axes.values())
    if n * len(spec.outputs) * 8 > TABLE_BYTES:
        raise ValueError(f"{n} nodes are too many to send: bind more axes")
    if n != size * bands:
        return df.withColumns({o: F.lit(None).cast("array<double>") for o in spec.outputs})  # a scene value outside its axis
    return interpolated(df.crossJoin(F.broadcast(packed(nodes, spec))), spec)  # one row, of the size checked above


def interpolated(df: DataFrame, spec: LutSpec, table: str = "table", band: Column | None = None) -> DataFrame:
    """``df`` with an array by band of each output, from the packed table in its column ``table``, which goes; NULL without one.

    With ``band``, a row's own band's index, the outputs are that band's values alone.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != table]
    axes = {}
    for k, (a, values) in enumerate(spec.axes.items()):
        i, w = bracket(F.col(a), values)
        axes |= {f"__i{k}": i, f"__w{k}": w}
    d = df.withColumns(axes)
    corners = []
    for bits in itertools.product((0, 1), repeat=len(spec.axes)):
        place, weight, stride = F.lit(0), F.lit(1.0), math.prod(len(v) for v in spec.axes.values())
        for k, (b, v) in enumerate(zip(bits, spec.axes.values())):
            stride //= len(v)
            place = place + F.least(F.col(f"__i{k}") + b, F.lit(len(v) - 1)) * stride
            weight = weight * (F.col(f"__w{k}") if b else 1 - F.col(f"__w{k}"))
        corners.append(F.struct(weight.alias("w"), F.get(table, place).alias("node")))
    if band is not None:
        one = lambda o: sum((c["w"] * F.get(c["node"][o], band) for c in corners[1:]), corners[0]["w"] * F.get(corners[0]["node"][o], band))
        return d.select(*keep, *[one(o).alias(o) for o in spec.outputs])
    d = d.select(*keep, F.when(weight.isNotNull() & F.col(table).isNotNull(), F.array(*corners)).alias("__corners"))
    zero = lambda o: F.transform(F.get("__corners", F.lit(0))["node"][o], lambda _: F.lit(0.0))
    value = lambda o: F.when(F.col("__corners").isNotNull(), F.aggregate("__corners", zero(o), lambda acc, c: F.zip_with(acc, c["node"][o], lambda x, y: x + c["w"] * y)))
    return d.select(*keep, *[value(o).alias(o) for o in spec.outputs])


def bind_scenes(nodes: DataFrame, spec: LutSpec, scenes: DataFrame, key: str, axes: Sequence[str]) -> tuple[DataFrame, LutSpec]:
    """bind() for every row of ``scenes`` (key, a column for each of ``axes``) in one plan: (key, table), packed, and the spec that is left.

    A scene meets the nodes that bracket its values by equi-join on their indices, which sums them by weight before
    it is packed. A scene with a value that is missing or outside its axis gets no row, so later look-ups are NULL.
    """
    left = LutSpec({a: v for a, v in spec.axes.items() if a not in axes}, spec.outputs, spec.units)
    d = scenes.select(key, *axes)
    for a in axes:
        values = list(map(float, spec.axes[a]))
        i, w = bracket(F.col(a), values)
        sides = F.array(F.struct(i.alias("i"), (1 - w).alias("w")), F.struct(F.least(i + 1, F.lit(len(values) - 1)).alias("i"), w.alias("w")))
        d = d.withColumn(f"__{a}", F.explode(F.filter(sides, lambda x: x["w"] > 0)))
    weight = F.lit(1.0)
    for a in axes:
        weight = weight * F.col(f"__{a}.w")
    d = d.select(key, weight.alias("__w"), *[F.col(f"__{a}.i").alias(f"i_{a}") for a in axes])
    met = d.join(by_band(nodes, spec), [f"i_{a}" for a in axes])
    spread = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(spread, key, *[f"i_{a}" for a in left.axes])  # few bytes and many sums: not to be drawn together again
    corners = met.groupBy(key, *[f"i_{a}" for a in left.axes]).agg(F.collect_list(F.struct("__w", "b")).alias("c"))  # two nodes an axis
    zero = F.transform(F.get("c", F.lit(0))["b"], lambda _: F.lit(0.0))
    value = lambda o: F.aggregate("c", zero, lambda acc, c: F.zip_with(acc, c["b"], lambda x, y: x + c["__w"] * y[o])).alias(o)
    rows = corners.select(key, place(left).alias("__place"), F.struct(*[value(o) for o in spec.outputs]).alias("node"))
    return _in_order(rows, (key,)), left


def checked(df: DataFrame, spec: LutSpec) -> DataFrame:
    """``df``; a value outside its axis is an error when it is read."""
    for a, v in spec.axes.items():
        lo, hi = float(min(v)), float(max(v))
        message = F.concat(F.lit(f"{a} outside {lo:g} to {hi:g}: "), F.col(a).cast("string"))
        df = df.withColumn(a, F.when(F.col(a).between(lo, hi), F.col(a)).otherwise(F.raise_error(message).cast("double")))
    return df


def nearest_nodes(nodes: DataFrame, spec: LutSpec, at: Mapping[str, float]) -> DataFrame:
    """Nodes nearest on each axis by itself (the lower one on ties)."""
    keep = F.lit(True)
    for a, x in at.items():
        v = list(map(float, spec.axes[a]))
        keep = keep & (F.col(f"i_{a}") == min(range(len(v)), key=lambda k: (abs(v[k] - x), k)))
    return nodes.where(keep)


def nearest(df: DataFrame, nodes: DataFrame, spec: LutSpec) -> DataFrame:
    """``df`` with the indices and outputs of each row's nearest node, axis by axis (the lower one on ties); NULL indices and outputs without a value."""
    at = {}
    for a, values in spec.axes.items():
        v = list(map(float, values))
        steps = [F.when(F.col(a) > (x + y) / 2, 1).otherwise(0) for x, y in zip(v, v[1:])]
        at[f"i_{a}"] = F.when(F.col(a).isNotNull(), sum(steps, F.lit(0)))
    return df.withColumns(at).join(nodes, list(at), "left")


def at_sensor(nodes: DataFrame, spec: LutSpec, sensor: DataFrame) -> DataFrame:
    """Nodes at a sensor's bands (wl_idx, wavelength), linear in wavelength; a band outside the table is an error."""
    ends = nodes.agg(F.min("wavelength"), F.max("wavelength")).first()
    wide = sensor.where(~F.col("wavelength").between(*ends)).limit(1).collect()  # one example for the message
    if wide:
        raise ValueError(f"band {wide[0]['wavelength']} nm is outside the table's {ends[0]} to {ends[1]} nm")
    axes = [f"i_{a}" for a in spec.axes]
    w = Window.partitionBy(*axes).orderBy("wavelength")
    seg = nodes.select(*axes, "wavelength", *spec.outputs, F.lead("wavelength").over(w).alias("w1"), *[F.lead(o).over(w).alias(f"{o}1") for o in spec.outputs])
    s = sensor.select("wl_idx", F.col("wavelength").alias("wl"))
    near = seg.join(F.broadcast(s), (F.col("wl") >= F.col("wavelength")) & ((F.col("wl") < F.col("w1")) | (F.col("w1").isNull() & (F.col("wl") == F.col("wavelength")))))  # a sensor's bands: some hundred rows
    t = F.coalesce((F.col("wl") - F.col("wavelength")) / (F.col("w1") - F.col("wavelength")), F.lit(0.0))
    return near.select(*axes, "wl_idx", F.col("wl").alias("wavelength"), *[(F.col(o) + t * F.coalesce(F.col(f"{o}1") - F.col(o), F.lit(0.0))).alias(o) for o in spec.outputs])


def band_key(wavelengths: Sequence[float]) -> str:
    """Twelve digits that name a sensor's bands: of their single-precision bytes."""
    return hashlib.md5(struct.pack(f"<{len(wavelengths)}f", *wavelengths)).hexdigest()[:12]


def cached(nodes: DataFrame, spec: LutSpec, sensor: DataFrame, folder: str, name: str) -> DataFrame:
    """at_sensor(), kept in ``folder`` by the sensor's bands: made at the first call, read at later ones."""
    spark = nodes.sparkSession
    key = band_key([r[0] for r in sensor.orderBy("wl_idx").select("wavelength").collect()])  # some hundred numbers
    path = f"{folder.rstrip('/')}/{name}-{key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        at_sensor(nodes, spec, sensor).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def from_files(spark: SparkSession, folder: str) -> tuple[DataFrame, LutSpec]:
    """A table in Parquet, nodes/ and axes/ (axis, i, value, unit), and its specification; units are checked to be one an axis."""
    axes: dict[str, dict[int, float]] = {}
    units: dict[str, str] = {}
    for r in spark.read.parquet(f"{folder}/axes").collect():  # the axes' values, some dozen rows
        axes.setdefault(r["axis"], {})[r["i"]] = r["value"]
        if units.setdefault(r["axis"], r["unit"]) != r["unit"]:
            raise ValueError(f"axis {r['axis']} has two units")
    nodes = spark.read.parquet(f"{folder}/nodes")
    order = [c[2:] for c in nodes.columns if c.startswith("i_")]
    outputs = [c for c in nodes.columns if not c.startswith("i_") and c not in ("wl_idx", "wavelength")]
    return nodes, LutSpec({a: [v for _, v in sorted(axes[a].items())] for a in order}, outputs, units)


def to_files(nodes: DataFrame, spec: LutSpec, folder: str) -> None:
    rows = [(a, i, float(v), (spec.units or {}).get(a)) for a, vs in spec.axes.items() for i, v in enumerate(vs)]
    nodes.sparkSession.createDataFrame(rows, "axis string, i int, value double, unit string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/axes")
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")


def held(x: Column, nodes: Sequence[float], values: Sequence[float]) -> Column:
    """Linear in one axis, held at its ends."""
    return literal_interp(x, nodes, values, "flat")


def sweep(nodes: DataFrame, spec: LutSpec, scene: Mapping[str, float], axis: str = "aot550") -> DataFrame:
    """Everything bound but one axis: a table of outputs by that axis and band."""
    out, left = bind(nodes, spec, {a: x for a, x in scene.items() if a != axis and a in spec.axes})
    pairs = [v for i, x in enumerate(left.axes[axis]) for v in (F.lit(i), F.lit(float(x)))]
    return out.withColumn(axis, F.create_map(*pairs)[F.col(f"i_{axis}")])


def synthetic(spark: SparkSession, spec: LutSpec, wavelengths: Sequence[float] = (), seed: int = 7) -> DataFrame:
    """Nodes whose outputs are multilinear in the axes, so that interpolation is exactly checkable."""
    import random

    rng = random.Random(seed)
    out = spec.grid(spark)
    if wavelengths:
        out = out.select("*", F.posexplode(F.array(*[F.lit(float(w)) for w in wavelengths])).alias("wl_idx", "wavelength"))
    for o in spec.outputs:
        value = F.lit(0.05 + 0.1 * rng.random())
        for a, v in spec.axes.items():
            span = (max(v) - min(v)) or 1.0
            value = value + F.col(a) / span * (0.01 + 0.02 * rng.random())
        out = out.withColumn(o, value + (F.col("wavelength") / 10000 if wavelengths else F.lit(0.0)))
    return out.drop(*spec.axes)


def generate(spark: SparkSession, spec: LutSpec, wavelengths: Sequence[float], model) -> DataFrame:
    """Nodes from a radiative-transfer model: ``model(axes, wavelengths)`` gives a node's outputs, a list by band each.

    The grid's nodes are dealt over the cluster; each is one call, say of an external program on the executor.
    """
    import pyarrow as pa

    names, outputs, wl = list(spec.axes), list(spec.outputs), [float(w) for w in wavelengths]

    def run(batches):
        for b in batches:
            got = [model({a: x for a, x in zip(names, row)}, wl) for row in zip(*(b.column(a).to_pylist() for a in names))]
            columns = [b.column(f"i_{a}") for a in names] + [pa.array([g[o] for g in got], pa.list_(pa.float64())) for o in outputs]
            yield pa.RecordBatch.from_arrays(columns, names=[f"i_{a}" for a in names] + outputs)

    schema = ", ".join([f"i_{a} int" for a in names] + [f"{o} array<double>" for o in outputs])
    grid = spec.grid(spark).repartition(max(spark.sparkContext.defaultParallelism, math.prod(len(v) for v in spec.axes.values()) // 64))
    table = grid.mapInArrow(run, schema)
    bands = F.arrays_zip(F.array(*[F.lit(w) for w in wl]).alias("wavelength"), F.sequence(F.lit(0), F.lit(len(wl) - 1)).alias("wl_idx"), *outputs)
    return table.select(*[f"i_{a}" for a in names], F.inline(bands))

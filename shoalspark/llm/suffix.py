"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

The suffix order is built blockwise over a cover sample, one bucket at a time:

* Cover sample. Of every ``length - gram + 1`` consecutive ``gram``-byte
  strings the one of least hash is sampled (leftmost on ties). Any two equal
  strings of ``length`` bytes hold a common sample at the same offset, which is
  what a difference cover gives by residues, at a sixth of the sample size;
  every window start belongs to exactly one sample.
* Ranks. The hash of a sample's gram names its bucket; the hash of the whole
  stretch in which its windows lie is its rank. Samples of equal rank are ties
  however long their texts agree: all their windows repeat, and no byte of
  them is looked at again.
* Buckets. Only where a bucket holds different ranks are bytes needed: one
  stretch per rank, at most ``2 * length`` bytes, is cut from the text, sent
  to the bucket, and its windows are sorted there, bucket by bucket, so memory
  is bounded by the largest bucket's differing stretches.

A gram that very many different stretches hold (more than ``hot``, counted
first) is not sorted in one place: its windows are dealt singly, by their own
hash and place, and counted with map-side combine.

Strings are told apart by 64-bit hashes, always within a bucket that another
64-bit hash names. The removed bytes are judged on the input; matches never
cross documents. Null texts are empty. Documents are told apart by id and
text: rows repeated with both are repeats of each other like any others, and
have one result each. A document of fewer than ``length`` bytes keeps all. Very
long texts are read whole, their samples found segment by segment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, binary_list, materialize, mix64, tidy
from .neardup import runs

LENGTH, GRAM, HOT = 200, 100, 50_000
_B = 0x5851F42D4C957F2D | 1
_BINV = pow(_B, -1, 1 << 64)
_SYMBOL = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
SEGMENT = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), U64)
    if n > 1:
        out[1] = U64(base)
        k = 1
        while k < n:
            top = min(2 * k, n)
            out[k:top] = out[: top - k] * U64(pow(base, k, 1 << 64))
            k *= 2
    return out[:n]


class Prefix:
    """Hashes of any stretches of a text, from one running sum."""

    up = powers(_B, 1 << 12)
    down = powers(_BINV, 1 << 12)

    def __init__(self, text: bytes):
        n = len(text)
        if n > len(Prefix.up):
            size = 1 << n.bit_length()
            Prefix.up, Prefix.down = powers(_B, size), powers(_BINV, size)
        s = _SYMBOL[np.frombuffer(text, np.uint8)]
        s *= Prefix.down[:n]
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(s, out=self.sum[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of each stretch of ``size`` bytes."""
        m = len(self.sum) - size
        return mix64((self.sum[size:] - self.sum[:m]) * Prefix.up[:m])

    def stretch(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sum[hi] - self.sum[lo]) * Prefix.up[lo] + (hi - lo).astype(U64))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the least value of each run of ``w`` values."""
    m = len(x) - w + 1
    packed = (x & ~U64((1 << 20) - 1)) | np.arange(len(x), dtype=U64)
    pad = -len(packed) % w
    if pad:
        packed = np.append(packed, np.full(pad, np.iinfo(U64).max, U64))
    rows = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U64((1 << 20) - 1)).astype(np.int64)


def samples(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(bucket, rank, position, first window, last window) of each sample that has windows."""
    if len(text) < length:
        e = np.empty(0, np.int64)
        return e.astype(U64), e.astype(U64), e, e, e
    p = Prefix(text)
    g = p.windows(gram)
    w = length - gram + 1
    out = []
    for at in range(0, len(g) - w + 1, SEGMENT):
        out.append(_least(g[at : at + SEGMENT + w - 1], w) + at)
    owner = np.concatenate(out)  # the sample of each window start; never falls
    first = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
    last = np.append(first[1:], len(owner)) - 1
    pos = owner[first]
    rank = p.stretch(first, last + length) + mix64((pos - first).astype(U64))
    return g[pos], rank, pos, first, last


def repeated(stretches: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """Of each (bytes, sample's place in them): which windows stand in another one at the same place from the sample."""
    keys, owner = [], []
    for i, (b, at) in enumerate(stretches):
        keys.append(_window_keys(b, at, length))
        owner.append(np.full(len(keys[-1]), i))
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # the bucket's suffixes, sorted
    same = flat[order][1:] == flat[order][:-1]
    hit = np.zeros(len(flat), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.split(hit, np.cumsum([len(k) for k in keys])[:-1])


def _cut(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def _ranges_batch(ids, ths, lo, hi, id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(ths, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["id", "th", "lo", "hi"])


def _window_keys(cut: bytes, before: int, length: int) -> np.ndarray:
    """A hash of each window of a stretch and its place from the sample."""
    h = Prefix(cut).windows(length)
    return mix64(h + mix64((np.arange(len(h)) - before).astype(U64)))


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """``a`` joined to ``b`` by document: id (NULL is one, too) and text hash."""
    b = b.withColumnsRenamed({"id": "__id", "th": "__th"})
    return a.join(b, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), how).drop("__id", "__th")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept text (null if it is no UTF-8)."""
    gram = gram or (GRAM if length == LENGTH else max(1, length // 2))
    assert length - gram < 1 << 15
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def sample(batches):
        for b in batches:
            rows, out, held = [], [[], [], [], []], 0
            ids, ths = b.column("id"), b.column("th").to_pylist()

            def batch():
                picked = ids.take(pa.array(np.repeat([r for r, _ in rows], [n for _, n in rows]).astype(np.int64)))
                return pa.RecordBatch.from_arrays([picked, *(pa.array(np.concatenate(x)) for x in out)], names=["id", "th", "h", "r", "at"])

            for row, text in enumerate(binary_list(b.column("text"))):
                h, r, pos, first, last = samples(text, length, gram)
                rows.append((row, len(h)))
                out[0].append(np.full(len(h), ths[row], np.int64)), out[1].append(h.view(np.int64)), out[2].append(r.view(np.int64))
                out[3].append((pos << 32) | ((pos - first) << 16) | (last - first))
                held += len(h)
                if held > 1 << 18:
                    yield batch()
                    rows, out, held = [], [[], [], [], []], 0
            if rows:
                yield batch()

    sampled = base.mapInArrow(lambda batches: tidy(sample(batches)), f"id {id_type}, th long, h long, r long, at long")
    # in bucket and rank order, a sample sees from its neighbours whether its rank or its bucket is shared
    order = Window.partitionBy("h").orderBy("r")
    around = sampled.withColumn("r0", F.lag("r").over(order)).withColumn("r1", F.lead("r").over(order)).where("r0 is not null or r1 is not null")
    tie = (F.coalesce(F.col("r0") == F.col("r"), F.lit(False))) | (F.coalesce(F.col("r1") == F.col("r"), F.lit(False)))
    # bytes are asked of every lone rank, and of the ends of a tie that border on another rank of the bucket
    border = F.coalesce(F.col("r0") != F.col("r"), F.lit(False)) | F.coalesce(F.col("r1") != F.col("r"), F.lit(False))
    around = materialize(around.select("h", "id", "th", "at", tie.alias("tie"), (border | ~tie).alias("ask")), "buckets")

    first = F.shiftright("at", 32) - F.shiftright("at", 16).bitwiseAND(0xFFFF)
    ties = around.where("tie").select("id", "th", first.alias("lo"), (first + F.col("at").bitwiseAND(0xFFFF) + length).alias("hi"))
    crowds = materialize(around.where("ask").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "crowds")
    crowded = not crowds.isEmpty()

    def asked(rows: DataFrame) -> DataFrame:
        """(h, id, th, lo, before, tie, cut): the bytes of stretches."""
        asks = rows.groupBy("id", "th").agg(F.collect_list(F.struct("h", "at", "tie")).alias("asks"))
        return _same(base, asks, "inner").select("id", "th", "text", "asks").mapInArrow(stretches, f"h long, id {id_type}, th long, lo long, before int, tie boolean, cut binary")

    def stretches(batches):
        seen = None
        for b in batches:
            for row, (key, th, text, asks_) in enumerate(zip(b.column("id").to_pylist(), b.column("th").to_pylist(), binary_list(b.column("text")), b.column("asks").to_pylist())):
                if (key, th) == seen:  # of rows alike, one after another, one will do
                    continue
                seen = key, th
                h, at, tie, cut, low = [], [], [], [], []
                for x in asks_:
                    pos, before, span = x["at"] >> 32, (x["at"] >> 16) & 0xFFFF, x["at"] & 0xFFFF
                    lo = pos - before
                    h.append(x["h"]), at.append(before), tie.append(x["tie"]), low.append(lo)
                    cut.append(text[lo : lo + span + length])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column("id").take(pa.array([row] * len(h), pa.int64())), pa.array([th] * len(h), pa.int64()), pa.array(low, pa.int64()), pa.array(at, pa.int32()), pa.array(tie, pa.bool_()), pa.array(cut, pa.binary())], names=["h", "id", "th", "lo", "before", "tie", "cut"])

    asks = around.where("ask")
    cuts = asked(asks.join(crowds, "h", "left_anti") if crowded else asks)

    def bucket(batches):
        ids, ths, los, his = [], [], [], []
        kind = pa.null()
        for run in runs(batches, ["h"]):
            kind = run.schema.field("id").type
            if run.num_rows < 2:
                continue
            rows = list(zip(run.column("cut").to_pylist(), run.column("before").to_pylist()))
            hits = repeated(rows, length)
            for hit, tie, key, th, lo in zip(hits, *(run.column(c).to_pylist() for c in ("tie", "id", "th", "lo"))):
                if not tie and hit.any():
                    p = np.flatnonzero(hit)
                    s, e = _cut(p, p + length)
                    ids += [key] * len(s)
                    ths += [th] * len(s)
                    los += (s + lo).tolist()
                    his += (e + lo).tolist()
            if len(ids) > 1 << 16:
                yield _ranges_batch(ids, ths, los, his, kind)
                ids, ths, los, his = [], [], [], []
        if ids:
            yield _ranges_batch(ids, ths, los, his, kind)

    range_type = f"id {id_type}, th long, lo long, hi long"
    spans = ties.unionByName(cuts.repartition("h").sortWithinPartitions("h").mapInArrow(bucket, range_type))
    if crowded:

        def singly(batches):
            for b in batches:
                for row, (h, tie, before, lo, cut) in enumerate(zip(*(b.column(c).to_pylist() for c in ("h", "tie", "before", "lo", "cut")))):
                    w = _window_keys(cut, before, length)
                    n = len(w)
                    same = pa.array([row] * n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array(w.view(np.int64)), b.column("id").take(same), b.column("th").take(same), pa.array(lo + np.arange(n)), pa.array([tie] * n, pa.bool_())], names=["h", "w", "id", "th", "lo", "tie"])

        windows = materialize(asked(asks.join(crowds, "h", "left_semi")).mapInArrow(singly, f"h long, w long, id {id_type}, th long, lo long, tie boolean"), "windows")
        again = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(windows.where("not tie").join(again, ["h", "w"], "left_semi").select("id", "th", "lo", (F.col("lo") + length).alias("hi")))
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def strip(batches):
        for b in batches:
            n, gone, count, digest, kept = [], [], [], [], []
            spans_ = b.column("spans")
            for i, text in enumerate(binary_list(b.column("text"))):
                n.append(len(text))
                x = spans_[i].values
                if x is None or not len(x):
                    s = e = np.empty(0, np.int64)
                else:
                    s, e = _cut(x.field("lo").to_numpy(), x.field("hi").to_numpy())
                gone.append(int((e - s).sum())), count.append(len(s))
                left = b"".join(text[a:z] for a, z in zip(np.append(0, e), np.append(s, len(text)))) if len(s) else text
                digest.append(hashlib.sha256(left).hexdigest())
                try:
                    kept.append(left.decode())
                except UnicodeDecodeError:
                    kept.append(left.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return _same(base, spans, "left").select("id", "text", "spans").mapInArrow(strip, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")

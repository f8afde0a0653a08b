"""Byte-level BPE encoding in overlapping chunks, and decoding.

A text of at most ``chunk`` characters is one piece. A longer one is cut into
chunks that overlap by ``overlap`` characters; the chunks are dealt over the
cluster and pre-tokenised in parallel. Where the pre-token boundaries of two
neighbours agree inside their overlap they have resynchronised: the pattern
looks only forward, so all later boundaries agree too. There the pieces are
stitched, each piece is encoded by itself, and the ids are put together in
order. Boundaries after white space are not used (a piece ending in white
space would be split otherwise), nor those so near a chunk's end that unseen
text could move them. Neighbours that do not resynchronise (say, in one letter a
million times) are put together as one piece, and the next pair starts anew.

Decoding concatenates the raw bytes of the ids.

Null texts are empty: no ids, no bytes. Repeated rows give repeated results:
the long texts are written to the shared scratch folder once, numbered, while
the plan is made (a scan for their lengths).
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

CHUNK, OVERLAP, GUARD = 1 << 16, 1 << 10, 8


@functools.cache
def _public():
    import public_tokenizers

    return public_tokenizers


@functools.cache
def encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_public().PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern():
    import regex

    return regex.compile(_public().PATTERN)


def boundaries(chunk: str, first: bool, last: bool, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Usable pre-token ends in the head and in the tail of a chunk, both relative to it."""
    n = len(chunk)
    head, tail = [], []
    for m in _pattern().finditer(chunk):
        e = m.end()
        if not first and e > overlap and (last or e < n - overlap):
            if last:
                break
            continue
        if e <= n - GUARD and not chunk[e - 1].isspace():
            if not first and e <= overlap:
                head.append(e)
            if not last and e >= n - overlap:
                tail.append(e)
    return head, tail


def stitch(chunks: list[tuple[int, int, list[int], list[int]]]) -> list[int | None]:
    """The cut before each chunk but the first, absolute; None where a pair does not resynchronise.

    chunks: (start, length, head, tail), in order. Cuts must rise, so that pieces stay in their chunks.
    """
    cuts, least = [], 0
    for (s0, n0, _, tail), (s1, _, head, _) in zip(chunks, chunks[1:]):
        common = sorted({s0 + e for e in tail} & {s1 + e for e in head})
        common = [x for x in common if x > least]
        if common:
            least = common[len(common) // 2]
        cuts.append(least if common else None)
    return cuts


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _whole(batches, id_name: str, path: str, pair: bool):
    enc = encoding(path)
    for batch in batches:
        ids_col, n_col, i_col, d_col = [], [], [], []
        for text in batch.column("__text").to_pylist():
            ids = enc.encode_ordinary(text or "")
            n_col.append(len(ids))
            if pair:
                ids_col.append(ids)
            else:
                i_col.append(_digest(ids))
                d_col.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        keep = [n for n in batch.schema.names if n not in ("__text", "__row")]
        cols = [batch.column(n) for n in keep]
        if pair:
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids_col, pa.list_(pa.int32()))], names=[*keep, "ids"])
        else:
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_col, pa.int64()), pa.array(i_col, pa.string()), pa.array(d_col, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def _ddl(df: DataFrame, drop: set[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop] + [more])


def _pieces(long: DataFrame, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row, k, ids csv, count, decoded bytes) of each piece, and the (row, k) of those put together from several chunks."""
    spark = long.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("__row").to_pylist(), batch.column("__text").to_pylist()):
                starts = list(range(0, max(1, len(text) - overlap), chunk - overlap))
                for at in range(0, len(starts), 64):
                    part = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array([len(starts)] * len(part), pa.int32()), pa.array(part, pa.int64()), pa.array([text[s : s + chunk] for s in part], pa.string())], names=["row", "k", "of", "start", "part"])

    chunks = long.select("__row", "__text").mapInArrow(cut, "row long, k int, of int, start long, part string").repartition(n, "row", "k")

    def marks(batches):
        for b in batches:
            got = [boundaries(t, k == 0, k == of - 1, overlap) + (len(t),) for t, k, of in zip(b.column("part").to_pylist(), b.column("k").to_pylist(), b.column("of").to_pylist())]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), b.column("start"), pa.array([g[2] for g in got], pa.int32()), pa.array([g[0] for g in got], ints), pa.array([g[1] for g in got], ints)], names=["row", "k", "start", "size", "head", "tail"])

    seen = chunks.mapInArrow(marks, "row long, k int, start long, size int, head array<int>, tail array<int>")
    seen = seen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "start", "size", "head", "tail"))).alias("all"))

    def stitched(batches):
        for b in batches:
            out = [[], [], [], [], [], []]
            for row, all_ in zip(b.column("row").to_pylist(), b.column("all").to_pylist()):
                parts = [(x["start"], x["size"], x["head"], x["tail"]) for x in all_]
                cuts = stitch(parts)
                firsts = [0] + [k for k, c in enumerate(cuts, 1) if c is not None]  # the first chunk of each piece
                for g, k in enumerate(firsts):
                    end = firsts[g + 1] if g + 1 < len(firsts) else len(parts)
                    lo, hi = (cuts[k - 1] if k else 0), (cuts[end - 1] if end < len(parts) else parts[-1][0] + parts[-1][1])
                    for c in range(k, end):
                        for column, value in zip(out, (row, c, k, end - k, lo, hi)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n in ("row", "lo", "hi") else pa.int32()) for n, x in zip(("row", "k", "piece", "of", "lo", "hi"), out)], names=["row", "k", "piece", "of", "lo", "hi"])

    spans = seen.mapInArrow(stitched, "row long, k int, piece int, of int, lo long, hi long")

    def encoded(batches):
        enc = encoding(path)
        for b in batches:
            csv, count, raw = [], [], []
            for parts, lo, hi in zip(b.column("parts").to_pylist(), b.column("lo").to_pylist(), b.column("hi").to_pylist()):
                text, at = [], lo
                for x in parts:  # in order, each from where the last one ended
                    text.append(x["part"][at - x["start"] : hi - x["start"]])
                    at = min(hi, x["start"] + len(x["part"]))
                ids = enc.encode_ordinary("".join(text))
                csv.append(",".join(map(str, ids))), count.append(len(ids)), raw.append(enc.decode_bytes(ids))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(csv, pa.string()), pa.array(count, pa.int64()), pa.array(raw, pa.binary())], names=["row", "k", "csv", "n", "raw"])

    met = chunks.drop("of").join(spans, ["row", "k"]).select("row", F.col("piece").alias("k"), "of", "lo", "hi", F.struct("start", "part").alias("x"))
    single = met.where("of = 1").select("row", "k", "lo", "hi", F.array("x").alias("parts"))
    several = met.where("of > 1").groupBy("row", "k", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("parts"))
    pieces = single.unionByName(several).mapInArrow(encoded, "row long, k int, csv string, n long, raw binary")
    return pieces, spans.where("of > 1").select("row", F.col("piece").alias("k")).distinct()


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK, overlap: int = OVERLAP, ids: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens and the digests of ids and decoded bytes; or, with ``ids``, the ids."""
    assert 4 * GUARD < 2 * overlap < chunk
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    more = "ids array<int>" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = _ddl(base, {"__text"}, more)
    is_long = F.length("__text") > chunk
    whole = lambda df: df.mapInArrow(lambda bs: tidy(_whole(bs, "", ranks_path, ids)), out)
    short = base.where(F.coalesce(~is_long, F.lit(True)))
    long = materialize(base.where(is_long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    pieces, _ = _pieces(long, ranks_path, chunk, overlap)
    joined = pieces.groupBy(F.col("row").alias("__row")).agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("k", "csv", "raw"))).alias("p"))
    csv = F.array_join(F.filter(F.transform("p", lambda x: x["csv"]), lambda x: x != ""), ",")
    if ids:
        joined = joined.select("__row", F.transform(F.split(csv, ","), lambda x: x.cast("int")).alias("ids"))
    else:
        raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), ""))
        joined = joined.select("__row", "n_tokens", F.sha2(csv.cast("binary"), 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))
    rest = joined.join(long.drop("__text"), "__row").select(*short.drop("__text").columns, *(["ids"] if ids else ["n_tokens", "ids_sha256", "decoded_sha256"]))
    return whole(short).unionByName(rest)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``df`` with the raw bytes of its ids, concatenated; null ids give no bytes."""

    def run(batches):
        enc = encoding(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([enc.decode_bytes(x or []) for x in b.column(ids_col).to_pylist()], pa.binary())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, _ddl(df, set(), f"`{out_col}` binary"))

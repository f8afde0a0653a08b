"""LM scoring with a log-frequency Bloom filter (Talbot & Osborne 2007).

The filter holds each n-gram with its quantised count: level q stands for a
count of ``base ** (q - 1)``, and an n-gram of level q is entered q times, as
(n-gram, 1) .. (n-gram, q). Reading a count is probing 1, 2, .. until a probe
misses, or passes the largest level entered. The filter is built in pieces:
n-gram hashes are dealt by their leading bits, each piece of the hash space
sorts and sums its own n-grams and sets the bits of its own piece of the
filter, sized by the entries counted there (``ENTRY_BITS`` or more each). So
the filter grows with the input and errs as often at every size, always
towards higher counts. The pieces are written as a table, the model. Scoring
sees that table only: while all pieces take at most ``SEND_BYTES`` (they are
summed first) they are broadcast and probed where the texts are; beyond it,
the levels of each block's distinct n-grams are those read where they met
their piece as it was made, a piece at a time, and go back to the block. Both
give the same levels. N-grams travel as sorted, delta-coded blobs of the leading
bits of their hashes, 14 more than it takes to count the text's bytes (44 up to
1 GB, all 64 from 1 PB on), so that as few meet by chance at every size.

The model is an interpolated bigram: P(w|h) = a(h) c(h w)/C(h) + (1 - a(h))
P1(w), a(h) = C(h) / (C(h) + K) and P1(w) = (c(w) + 1) / (N + V + 1), with all
counts read from the filter. c is the least count a level stands for and C the
most, so that the followers of a history come to no more than it, and P(.|h)
and P1 sum to one at most over the vocabulary (quantising leaves the rest
unassigned). An end token closes every text and opens the next one's history.

The base score needs each token's exact count. Each block sends its distinct
tokens (not its occurrences) the same way, and gets their exact counts back.

Null texts are empty: one token, the end. A null id hashes as an empty string.
Repeated rows are learned from and scored each. Very long texts are read whole,
in the block they fall in.
With nothing to learn from, N = V = 0: the base score is that of the formula
(log10 of 1) and the score is 0 a token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TokenHashes, U64, binary_list, materialize, mix64, row_count_partitions, tidy

FILTER_BITS, ENTRY_BITS, PROBES, LEVEL_BASE, BACKOFF = 1 << 20, 10, 3, 2.0, 2.0
END = b""  # never a word
PIECES = 64  # pieces of the filter, at least; more as the input grows
SEND_BYTES = 64 << 20  # of all pieces, that are broadcast at most


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hash of each token with its predecessor; the first follows the end token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[0] = h[-1]
    return mix64(mix64(before + U64(0x9E3779B97F4A7C15)) + h)


def level(count: np.ndarray, base: float = LEVEL_BASE) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9).astype(np.int64)


def places(h: np.ndarray, q: int, bits: int, probes: int = PROBES) -> list[np.ndarray]:
    """Bit places, inside a piece of ``bits``, of the n-grams at a level."""
    x = mix64(h + U64(q * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    step = (x >> U64(32)) | U64(1)
    return [(x + U64(i) * step) & U64(bits - 1) for i in range(probes)]


class Filter:
    """Bits in ``pieces`` equal parts; an n-gram's part is named by its leading bits. No level is above ``top``."""

    def __init__(self, data: np.ndarray, pieces: int, probes: int = PROBES, base: float = LEVEL_BASE, top: int = 64):
        self.data, self.pieces, self.probes, self.base, self.top = data, pieces, probes, base, top
        self.bits = len(data) * 8 // pieces
        self.shift = U64(64 - (pieces.bit_length() - 1))

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Estimated counts: the level's count for n-grams held, 0 for others."""
        return counts_of(self.levels(h), self.base)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels held of n-grams, 0 for those not held."""
        q = np.zeros(len(h), np.int64)
        at = np.arange(len(h))
        start = (h >> self.shift) * U64(self.bits) if self.pieces > 1 else np.zeros(len(h), U64)
        n = 1
        while len(at) and n <= self.top:
            held = np.ones(len(at), bool)
            for p in places(h[at], n, self.bits, self.probes):
                live = np.flatnonzero(held)
                b = p[live] + start[at[live]]
                held[live] = (self.data[(b >> U64(3)).astype(np.int64)] >> (b & U64(7)).astype(np.uint8)) & 1
            at = at[held]
            q[at] = n
            n += 1
        return q


def counts_of(q: np.ndarray, base: float = LEVEL_BASE) -> np.ndarray:
    return np.where(q > 0, base ** (q.astype(np.float64) - 1), 0.0)


KEY_BITS = 44


def key_bits(n_bytes: int) -> int:
    """Leading bits of a hash that n-grams are told apart by."""
    return min(64, max(KEY_BITS, int(n_bytes).bit_length() + 14))


def lead(h: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """What the filter knows an n-gram by: the leading bits of its hash."""
    return (h >> U64(64 - bits)) << U64(64 - bits)


def pack(h: np.ndarray, c: np.ndarray, bits: int = KEY_BITS) -> bytes:
    """Sorted hashes (kept to their leading bits) and their counts as delta bytes, plane by plane."""
    import zstandard

    h = h >> U64(64 - bits)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    h, c = h[first], np.minimum(np.add.reduceat(c, first), (1 << 32) - 1)
    d = np.diff(h, prepend=U64(0))
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(h).to_bytes(4, "little") + bytes([bits]) + zstandard.ZstdCompressor(level=1).compress(planes + c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, bits = int.from_bytes(blob[:4], "little"), blob[4]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5:]), np.uint8)
    d = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T)
    c = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(d.view("<u8").ravel(), dtype=U64) << U64(64 - bits), c.astype(np.int64)


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def piece_count(n_bytes: int) -> int:
    """Pieces, a power of two: one to about 8 MB of text."""
    return 1 << max(PIECES.bit_length() - 1, int(n_bytes // (8 << 20)).bit_length())


def cut(h: np.ndarray, pieces: int) -> tuple[list[int], np.ndarray]:
    """The pieces that sorted hashes fall in, and where each piece begins and ends."""
    cuts = np.searchsorted(h >> U64(64 - (pieces.bit_length() - 1)), np.arange(pieces + 1).astype(U64))
    return np.flatnonzero(cuts[:-1] < cuts[1:]).tolist(), cuts


def piece_filter(h: np.ndarray, q: np.ndarray, least: int) -> Filter:
    """The filter of one piece's n-grams and levels: ``ENTRY_BITS`` bits or more to every entry."""
    bits = max(8, least, 1 << (max(1, int(q.sum()) * ENTRY_BITS) - 1).bit_length())
    held = np.zeros(bits, bool)
    top = int(q.max()) if len(q) else 0
    for n in range(1, top + 1):
        for p in places(h[q >= n], n, bits):
            held[p.astype(np.int64)] = True
    return Filter(np.packbits(held, bitorder="little"), 1, top=top)


def word_order(local: TokenHashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's tokens and their n-gram hashes, and the order of the hashes (of the tokens on ties)."""
    words, h = list(local), mix64(local.hash[: len(local)])
    order = np.argsort(h, kind="stable")
    if (h[order][1:] == h[order][:-1]).any():
        order = np.array(sorted(range(len(words)), key=lambda i: (h[i], words[i])))
    return words, h, order


def count_blocks(dealt: DataFrame, pieces: int, bits: int = KEY_BITS) -> DataFrame:
    """(block, piece, grams, words, counts): a block's n-grams and tokens in each piece, with their counts in texts to learn from."""

    def send(block: int, local: TokenHashes, learn: list, other: list):
        import zstandard

        words, h, order = word_order(local)
        n_of = np.bincount(np.concatenate([k for k, _ in learn] or [np.empty(0, np.int64)]), minlength=len(words))
        h1, c1 = np.unique(np.concatenate([p for _, p in learn] or [np.empty(0, U64)]), return_counts=True)
        h2 = np.unique(np.concatenate([p for _, p in other] or [np.empty(0, U64)]))
        g, c = np.concatenate([h1, h2, h]), np.concatenate([c1, np.zeros(len(h2), np.int64), n_of])
        at = np.argsort(g, kind="stable")
        g, c = g[at], c[at]
        full, cuts = cut(g, pieces)
        _, ends = cut(h[order], pieces)
        packer = zstandard.ZstdCompressor(level=1)
        rows = []
        for i in full:
            mine = order[ends[i] : ends[i + 1]]
            rows.append((pack(g[cuts[i] : cuts[i + 1]], c[cuts[i] : cuts[i + 1]], bits), packer.compress(b"\n".join([words[j] for j in mine])), n_of[mine].astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int32()), pa.array(full, pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(2)), pa.array([packer.compress(r[2]) for r in rows], pa.binary())], names=["block", "piece", "grams", "words", "counts"])

    def run(batches):
        block, local, learn, other = None, TokenHashes(), [], []
        for batch in batches:
            for b, held, t in zip(batch.column("block").to_pylist(), batch.column("held_out").to_pylist(), binary_list(batch.column("text"))):
                if b != block:
                    if block is not None:
                        yield from send(block, local, learn, other)
                    block, local, learn, other = b, TokenHashes(), [], []
                k = local.places(tokens(t))
                (learn if held is False else other).append((k, bigrams(local.hash[k])))
        if block is not None:
            yield from send(block, local, learn, other)

    return dealt.select("block", "held_out", "text").sortWithinPartitions("block").mapInArrow(lambda batches: tidy(run(batches)), "block int, piece int, grams binary, words binary, counts binary")


def learn(counted: DataFrame, pieces: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(piece, filter, top, n, v, asked), written: a row for each piece of the model, with its bits, its largest level and the
    tokens and distinct tokens learned. ``asked`` holds the levels of each block's n-grams and the exact counts of its
    tokens, in their order, so that n-grams are shuffled and stored no second time."""
    least = 1 << max(3, (filter_bits // pieces).bit_length() - 1)
    asked = pa.list_(pa.struct([("block", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary())]))

    def run(batches):
        import zstandard

        from .neardup import runs

        packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for piece in runs(batches, ["piece"]):
            blobs = [unpack(x) for x in piece.column("grams").to_pylist()]
            h, inverse = np.unique(np.concatenate([x[0] for x in blobs]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([x[1] for x in blobs]))
            held = total > 0
            f = piece_filter(h[held], level(total[held]), least)
            counts = [np.frombuffer(unpacker.decompress(x), "<i8") if x else np.empty(0, np.int64) for x in piece.column("counts").to_pylist()]
            words = [unpacker.decompress(x).split(b"\n") if len(c) else [] for x, c in zip(piece.column("words").to_pylist(), counts)]
            code = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            exact = np.bincount(code, weights=np.concatenate(counts)).astype(np.int64)
            back = [packer.compress(y.tobytes()) for y in np.split(exact[code], np.cumsum([len(c) for c in counts])[:-1])]
            q = f.levels(h).astype(np.uint8)[inverse]
            levels = [packer.compress(y.tobytes()) for y in np.split(q, np.cumsum([len(x[0]) for x in blobs])[:-1])]
            rows = [{"block": b, "levels": x, "counts": c} for b, x, c in zip(piece.column("block").to_pylist(), levels, back)]
            yield pa.RecordBatch.from_arrays([
                pa.array([piece.column("piece")[0].as_py()], pa.int32()), pa.array([f.data.tobytes()], pa.binary()), pa.array([f.top], pa.int32()),
                pa.array([int(exact.sum())], pa.int64()), pa.array([int((exact > 0).sum())], pa.int64()), pa.array([rows], asked),
            ], names=["piece", "filter", "top", "n", "v", "asked"])

    dealt = counted.repartition(pieces, "piece").sortWithinPartitions("piece")
    return materialize(dealt.mapInArrow(lambda batches: tidy(run(batches)), "piece int, filter binary, top int, n long, v long, asked array<struct<block:int,levels:binary,counts:binary>>"), "model")


def probed(h: np.ndarray, sent: dict[int, tuple[bytes, int]], pieces: int) -> np.ndarray:
    """Levels of sorted n-grams in the pieces sent; a piece that was never made holds none."""
    q = np.zeros(len(h), np.int64)
    full, cuts = cut(h, pieces)
    for i in full:
        if i in sent:
            bits, top = sent[i]
            q[cuts[i] : cuts[i + 1]] = Filter(np.frombuffer(bits, np.uint8), 1, top=top).levels(h[cuts[i] : cuts[i + 1]])
    return q


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS, block_bytes: int = 8 << 20, send_bytes: int = SEND_BYTES) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model is broadcast if its pieces take at most ``send_bytes``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), held_out.alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n_bytes = _bytes(base, "text")
    blocks, pieces, bits = row_count_partitions(spark, n_bytes, block_bytes), piece_count(n_bytes), key_bits(n_bytes)
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block")
    learned = learn(count_blocks(dealt, pieces, bits), pieces, filter_bits)
    model = learned.select("piece", "filter", "top")
    total = learned.agg(F.sum("n"), F.sum("v"), F.sum(F.octet_length("filter"))).first()
    n, v, size = (int(x or 0) for x in total)
    sent = None
    if size <= send_bytes:
        sent = spark.sparkContext.broadcast({r["piece"]: (bytes(r["filter"]), r["top"]) for r in model.toLocalIterator()})
    each = learned.select("piece", F.explode("asked").alias("a"))
    answers = each.select(F.col("a.block").alias("block"), "piece", (F.lit(None).cast("binary") if sent is not None else F.col("a.levels")).alias("levels"), F.col("a.counts").alias("counts"))

    def score_block(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        floor = n + v + 1
        local = TokenHashes()
        each = [local.places(tokens(t)) for t in binary_list(docs_table.column("text").combine_chunks())]
        unpacker = zstandard.ZstdDecompressor()
        answers = answers.sort_by("piece")
        joined = lambda c, t: np.frombuffer(b"".join(unpacker.decompress(x) if x else b"" for x in answers.column(c).to_pylist()), t)
        _, words, order = word_order(local)
        exact = np.empty(len(local), np.int64)
        exact[order] = joined("counts", "<i8")
        h, at = np.unique(lead(np.concatenate([words, *(bigrams(local.hash[k]) for k in each)]), bits), return_inverse=True)
        levels = probed(h, sent.value, pieces) if sent is not None else joined("levels", np.uint8)
        if len(levels) != len(h):
            raise RuntimeError("the levels of a block's n-grams are not all there")
        counts = counts_of(levels)
        c1, at = counts[at[: len(local)]], at[len(local) :]
        n_tok, n_known, base_score, scores = [], [], [], []
        past = 0
        for i in range(0, len(each), 64):
            some = each[i : i + 64]
            k = np.concatenate(some)
            size = np.array([len(x) for x in some])
            start = np.append(0, np.cumsum(size)[:-1])
            c = exact[k]
            n_tok += size.tolist()
            n_known += np.add.reduceat((c > 0).astype(np.int64), start).tolist()
            logs = np.log10((c + 1) / floor)
            base_score += [float(logs[s : s + z].sum()) for s, z in zip(start, size)]
            if not n:
                scores += [0.0] * len(some)
                continue
            c2 = counts[at[past : past + len(k)]]
            past += len(k)
            w = c1[k]
            most = np.where(w > 0, LEVEL_BASE * w - 1, 0.0)  # the most a level stands for
            prior = np.append(most[-1:], most[:-1])
            prior[start] = most[start + size - 1]  # a text's first token follows the end token
            p1 = (w + 1) / floor
            a = prior / (prior + BACKOFF)
            p2 = a * np.minimum(c2, prior) / np.maximum(prior, 1) + (1 - a) * p1
            logp = np.minimum(0.0, np.log10(np.where(prior > 0, p2, p1)))
            scores += [float(logp[s : s + z].sum()) for s, z in zip(start, size)]
        return pa.table({id_col: docs_table.column("id"), "held_out": docs_table.column("held_out"), "n_tokens": pa.array(n_tok, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(each), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(scores, pa.float64())})

    id_type = base.schema["id"].dataType.simpleString()
    out = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block, out)

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoalspark.llm import ngramlm

from .helpers import ODD, docs

def HELD():  # noqa: N802
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2


TEXTS = [*ODD, *(f"the cat sat on mat {i % 5} The Dog" for i in range(40)), "unseen wordsé"]


def test_counts_and_base_as_the_formula(spark):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in ngramlm.score(docs(spark, TEXTS), HELD(), filter_bits=1 << 20).collect()}
    assert len(got) == len(TEXTS)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])


def test_model_beats_the_base_on_held_out_text(spark):
    rows = [r for r in ngramlm.score(docs(spark, TEXTS), HELD(), filter_bits=1 << 20).collect() if r["held_out"] and r["n_tokens"] > 5]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_filter_keeps_levels():
    rng = np.random.default_rng(1)
    h = np.unique(ngramlm.lead(rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)))
    q = ngramlm.level(rng.integers(1, 60, len(h)))
    bits = np.zeros(1 << 20, bool)
    part = (1 << 20) // 64
    f0 = ngramlm.Filter(np.zeros(1 << 17, np.uint8), 64)
    for n in range(1, int(q.max()) + 1):
        for p in ngramlm.places(h[q >= n], n, part):
            bits[(p + (h[q >= n] >> f0.shift) * np.uint64(part)).astype(np.int64)] = True
    f = ngramlm.Filter(np.packbits(bits, bitorder="little"), 64)
    got = f.counts(h)
    assert (got >= 2.0 ** (q - 1)).all() and (got == 2.0 ** (q - 1)).mean() > 0.95  # errs upwards only
    other = ngramlm.lead(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    assert (f.counts(other) > 0).mean() < 0.05


def test_blobs_round_trip():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64))
    a, c = ngramlm.unpack(ngramlm.pack(h, np.arange(1, 501)))
    assert (a == ngramlm.lead(h)).all() and (c == np.arange(1, 501)).all()


def test_nothing_to_learn_and_empty(spark):
    r = ngramlm.score(docs(spark, ["a b"]), F.lit(True), filter_bits=1 << 18).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
    assert ngramlm.score(docs(spark, []), F.lit(False), filter_bits=1 << 18).count() == 0


def test_filter_grows_with_its_entries():
    rng = np.random.default_rng(3)
    for size in (1_000, 300_000):
        h = np.unique(ngramlm.lead(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)))
        q = ngramlm.level(rng.zipf(1.7, len(h)).clip(1, 1 << 20))
        f = ngramlm.piece_filter(h, q, 8)
        assert len(f.data) * 8 >= 10 * q.sum()
        got = f.levels(h)
        assert (got >= q).all() and got.max() <= q.max() and (got == q).mean() > 0.95
        other = ngramlm.lead(rng.integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1 << 40))
        assert (f.levels(other) > 0).mean() < 0.03


def test_scores_do_not_depend_on_the_least_size(spark):
    """A filter once held to so few bits took every n-gram for a common one."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 400)) for _ in range(60)]
    small, large = ({r["doc_id"]: r["score"] for r in ngramlm.score(docs(spark, texts), HELD(), filter_bits=b).collect()} for b in (1 << 12, 1 << 24))
    assert all(abs(small[i] - large[i]) < 0.03 * abs(large[i]) for i in large)


def plain_model(words, held):
    """The docstring's model with plain dictionaries: P1 and P(w|h)."""
    c1 = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    c2 = Counter(x for ws, h in zip(words, held) if not h for x in zip([None, *ws], ws))
    n, v = sum(c1.values()), len(c1)
    low = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    top = lambda c: 2 ** c.bit_length() - 1 if c else 0
    p1 = lambda w: (low(c1[w]) + 1) / (n + v + 1)

    def p2(w, h):
        t = top(c1[h])
        a = t / (t + ngramlm.BACKOFF)
        return a * min(low(c2[h, w]), t) / t + (1 - a) * p1(w) if t else p1(w)

    return c1, p1, p2


def test_score_as_a_plain_dictionary_model(spark):
    rng = np.random.default_rng(5)
    texts = [*TEXTS, *(" ".join(f"w{x}" for x in rng.zipf(1.6, 80).clip(1, 300)) for _ in range(40)), "w1 " * 5000]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    vocabulary, p1, p2 = plain_model(words, held)
    got = {r["doc_id"]: r["score"] for r in ngramlm.score(docs(spark, texts), HELD()).collect()}
    for i, ws in enumerate(words):
        assert math.isclose(got[i], sum(math.log10(p2(w, h)) for h, w in zip([None, *ws], ws)), rel_tol=1e-9), (i, texts[i])
    # the model hands out no more than there is
    assert sum(map(p1, vocabulary)) <= 1 and all(sum(p2(w, h) for w in vocabulary) <= 1 + 1e-9 for h in vocabulary)


def test_hashes_are_kept_longer_as_the_input_grows():
    assert [ngramlm.key_bits(x) for x in (0, 1 << 20, 10**9, 10**12, 10**14)] == [44, 44, 44, 54, 61]
    h = np.sort(np.random.default_rng(6).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    for bits in (44, 58, 64):
        a, _ = ngramlm.unpack(ngramlm.pack(h, np.ones(500, np.int64), bits))
        assert (a == ngramlm.lead(h, bits)).all()


def test_repeated_rows_are_learned_from_and_scored_each(spark):
    df = docs(spark, ["a b c", "a b d", "q"])
    one = {r["doc_id"]: r for r in ngramlm.score(df, F.lit(False)).collect()}
    two = ngramlm.score(df.unionByName(df), F.lit(False)).collect()
    assert len(two) == 6 and all(r["train_tokens"] == 2 * one[0]["train_tokens"] and r["n_tokens"] == one[r["doc_id"]]["n_tokens"] for r in two)
    assert len({(r["doc_id"], r["score"]) for r in two}) == 3


def test_sent_and_joined_models_score_alike(spark):
    rng = np.random.default_rng(7)
    texts = [*TEXTS, *(" ".join(f"w{x}" for x in rng.zipf(1.5, 120).clip(1, 900)) for _ in range(40)), "w1 long " * 60_000]
    df = docs(spark, texts)
    sent, joined = ({r["doc_id"]: tuple(r) for r in ngramlm.score(df, HELD(), block_bytes=1 << 12, send_bytes=b).collect()} for b in (ngramlm.SEND_BYTES, 0))
    assert sent == joined and len(sent) == len(texts)

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from shoalspark.llm import suffix

from .helpers import ODD, docs


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = {}
    for k, b in enumerate(raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passage = letters(300)
    texts = [*ODD, passage, letters(500) + passage + letters(90), passage[:150] + "#" + passage[151:], passage[20:230], letters(210), "ab" * 400, "x" * 199, "x" * 200, letters(50) + passage[:200] + "|" + passage[:200]]
    texts += [letters(120) + passage[k : k + 199 + k % 4] + letters(150) for k in range(30)]
    return texts


def test_as_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs(spark, texts)).collect()}
    assert got == brute(texts, 200)


def test_other_lengths(spark):
    texts = corpus()[:25]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs(spark, texts), length=16).collect()}
    assert got == brute(texts, 16)


def test_repeated_rows_and_empty(spark):
    df = docs(spark, ["q" * 10 + "".join(map(str, range(200))), "short"])
    twice = suffix.dedup(df.unionByName(df)).collect()
    assert sorted((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in twice) == [(0, 0), (0, 0), (1, 5), (1, 5)]
    assert suffix.dedup(docs(spark, [])).count() == 0


def test_crowded_grams_are_dealt_by_window(spark):
    """A common passage in many surroundings: its windows are counted singly, with the same answer."""
    texts = corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs(spark, texts), hot=3).collect()}
    assert got == brute(texts, 200)


def test_very_long_text_and_null_ids(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = letters(5000)
    texts = [letters(suffix.SEGMENT + 300) + shared + letters(1000) + shared[:1000], shared[100:900], letters(400)]
    df = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(df).collect()}
    want = brute(texts, 200)
    assert got == {0: want[0], None: want[1], 2: want[2]}

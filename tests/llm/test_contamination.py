import hashlib
import random
import re

import pytest

from shoalspark.llm import contamination

from .helpers import ODD, docs

R = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return R.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(name)
    out = {}
    for i, t in enumerate(texts):
        w, met = words(t), set()
        hit = [False] * len(w)
        for n in {n for n, _ in windows}:
            for k in range(len(w) - n + 1):
                names = windows.get((n, tuple(w[k : k + n])))
                if names:
                    hit[k : k + n] = [True] * n
                    met |= names
        met.discard(None)
        out[i] = (len(w), sum(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), any(hit))
    return out


def case():
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "ünï", "42", "gamma", "delta", "eps", "zeta"])
    items = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 9, 10, 11, 30, 30, 45, 6))] + [("9", None), ("10", "..."), ("11", "x " * 14), ("5", "alpha")]
    texts = [*ODD, "x " * 9, "x " * 12, "X-x,x" * 30]
    for _ in range(40):
        n = rng.randrange(len(items))
        w = words(items[n][1]) or ["q"]
        a = rng.randrange(len(w))
        texts.append(" ".join([word() for _ in range(rng.randrange(30))] + w[a : a + rng.randrange(1, 25)] + [word() for _ in range(20)]).upper())
    return texts, items


@pytest.mark.parametrize("bound", [contamination.BROADCAST_WORDS, 0])
def test_as_brute_force(spark, bound):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as h", "2 as n_hit")
    got = contamination.decontaminate(docs(spark, texts), bench, broadcast_words=bound).collect()
    assert {r["doc_id"]: (r[1], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == brute(texts, items)


def test_runs_of_hits(spark):
    bench = spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    r = contamination.decontaminate(docs(spark, ["zero one two three four five six seven eight nine ten zero"]), bench).first()
    assert [tuple(x) for x in r["hit_words"]] == [(1, 11)] and r["items"] == ["a"]


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert contamination.decontaminate(docs(spark, []), bench).count() == 0
    assert contamination.decontaminate(docs(spark, ["a b"]), bench).first()["contaminated"] is False


@pytest.mark.parametrize("bound", [contamination.BROADCAST_WORDS, 0])
def test_long_repetitive_texts_and_repeated_rows(spark, bound):
    """Equal words by the hundred thousand cost what other words do."""
    items = [("r", "same " * 400), ("s", "same " * 3), ("u", " ".join(f"w{k % 7}" for k in range(300)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["same " * 120_000, " ".join(f"w{k % 7}" for k in range(100_000)), "clean text"]
    rows = docs(spark, texts)
    got = contamination.decontaminate(rows.unionByName(rows), bench, broadcast_words=bound).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == sorted([(0, 120_000, 120_000, 2), (1, 100_000, 100_000, 1), (2, 2, 0, 0)] * 2)

import itertools
import random

import numpy as np

from shoalspark.llm import neardup

from .helpers import ODD, docs


def brute(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [*ODD, "A b", "a B", "one two three four", "ONE two three four"]
    for size, edits in ((2, 1), (3, 2), (30, 2), (12, 6), (5, 0)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(60)) for _ in range(20)] + ["x " * 4000, "x " * 4001]
    return texts


def check(spark, texts, percent=85, **kw):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, texts), percent=percent, **kw).collect()}
    assert got == brute(texts, percent)


def test_as_brute_force(spark):
    check(spark, corpus())


def test_crowded_regions_and_blocks(spark):
    check(spark, corpus(2), crowd=4, block=8)


def test_empty(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_pairs_at_the_threshold_are_found_in_crowded_regions(spark):
    """Each group: 70 classes of one signature, and one whose values agree with theirs at 0.8."""
    rng = np.random.default_rng(5)
    rows, edges = [], []
    for g in range(150):
        hub = rng.integers(0, 1 << 16, neardup.TREES * 8).astype(np.uint16)
        edge = np.where(rng.random(len(hub)) < 0.8, hub, hub + np.uint16(1))
        as_list = lambda x: x.astype(">u2").view(">i8").astype(np.int64).tolist()
        rows += [(g * 100 + k, as_list(hub)) for k in range(70)] + [(g * 100 + 70, as_list(edge))]
        edges.append(g * 100 + 70)
    found = neardup.regions(spark.createDataFrame(rows, "id long, sig array<long>"), neardup.TREES, neardup.CROWD)
    assert {r["id"] for r in found.where("id % 100 = 70").select("id").distinct().collect()} == set(edges)


def test_default_is_eighty_percent(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, corpus(3))).collect()}
    assert got == brute(corpus(3), 80)


def test_repeated_ids_and_rows(spark):
    """Two texts under one id are judged each by itself; equal rows alike."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(3, a), (5, b), (5, a), (5, a), (7, b + " end"), (7, None), (None, a)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    assert got == [(3, 36, 3, True), (5, 36, 3, False), (5, 36, 3, False), (5, 36, 5, True), (7, 0, 7, True), (7, 37, 5, False)]


def test_crowded_regions_at_eighty_percent(spark):
    """Places beyond the third join what the first three leave apart, and nothing is linked twice over."""
    check(spark, corpus(4), percent=80, crowd=4, block=8)
    check(spark, corpus(5), percent=80, crowd=2, block=2048)
    check(spark, corpus(5), percent=80, crowd=2, block=2)


def test_large_clusters_are_compared_part_by_part(spark):
    """Blocks of a few texts: parts that meet only through one pair, and strays, are linked as brute force links them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    chain, text = [], [word() for _ in range(100)]
    for _ in range(40):  # each links to the next ones only
        chain.append(" ".join(text))
        text = list(text)
        text[rng.randrange(100)] = word()
    for share in (2, 5, 16):
        check(spark, corpus(6) + chain, percent=85, share=share)
    check(spark, corpus(7) + chain, percent=80, share=3, crowd=4)

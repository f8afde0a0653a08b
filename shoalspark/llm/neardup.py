"""MinHash near-duplicates with an LSH forest (Bawa, Condie & Ganesan 2005).

A document's set is its distinct ``words``-word shingles (A-Z lower-cased,
words parted by ASCII white space; a text of fewer words is one shingle).
Documents of one set are one class, named by the set's digest, so that ids may
repeat. Every class has 2 * ``trees`` labels of four MinHash values; each tree
is an order of all labels.

* In the order of a label the classes that agree in it, its longest common
  prefix, stand side by side: a region. (Runs of one prefix are found by
  counting prefixes, not by sorting rows, so that a run that holds a third of
  all rows meets no task whole.) The members of a region are compared with each
  other on their full signatures, and one spanning forest of the pairs that may
  reach the threshold is passed on: lines, never pairs squared.
* A crowded region (more than ``crowd`` members) is compared in two steps: all
  with its first member, which joins most of a tight group; then those that are
  in another cluster than most, the strays, with all. Both deal the members over
  blocks, each to one.
* Where the strays are a crowd themselves, in a region of more than ``block``
  members, the depth rises to eight values: the
  label with each of the ``ring`` labels that stand 1, 5, 12, .. places on, the
  last followed by the first, a few places at a time, in deeper regions that
  more than one cluster meets in.
* Connected regions make candidate clusters. Each cluster's texts are sent
  there, and links are confirmed on the full sets: a pair is compared unless it
  is linked already through others. A large cluster is dealt over blocks, each
  text to one; then one text of each part found there is compared with those of
  other blocks; only what is not yet one part is compared member by member, the
  strays with all, the largest part with the strays. So a tight cluster of any
  size costs what its texts do, and no pair that may link is left out.
* Components of the confirmed links are found by distributed star rounds.

A pair at Jaccard 0.85 is missed with a chance of 6e-11 (0.522 to a label, 32
labels), and of 7.5e-6 if the strays crowd all its regions (3 places on); at
0.80 with 5e-8 and, 11 places on, 5e-6 (latter figures: 4 million random
pairs). The signature filter misses one with a chance of 2e-5.

Null or blank texts have no set, are linked with nothing and kept. A null id
is linked with nothing and kept. Different texts under one id are documents of
their own: each has the component of its own text. Equal rows have one result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenHashes, U64, binary_list, components, materialize, ngram_hashes, tidy

WORDS, PERCENT, TREES, DEPTH, CROWD, BLOCK, SHARE = 5, 80, 16, 8, 64, 2048, 512
#: How many places on the labels stand that a crowded region's label is taken with; the first three from 0.85 up.
RING = (1, 5, 12, 14, 3, 7, 9, 10, 2, 6, 11)
#: How many further places are taken at once, and rows (some 50 bytes each) that are sent to all tasks at most.
STEP, SENT = 3, 500_000
_SEED = 20240229


def shingles(words: list[bytes], cache: TokenHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    if not words:
        return np.empty(0, U64)
    h = cache.array(words)
    return np.unique(ngram_hashes(h, min(n, len(h))) ^ U64(min(n, len(h))))


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 63, m, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, m, dtype=U64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of each least hash."""
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048, None] * a
        x += b
        x >>= U64(32)
        np.minimum(low, x.min(axis=0).astype(np.uint32), out=low)
    return low.astype(np.uint16)


def jaccard_links(sets: list[np.ndarray], percent: int, *apart: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among sets whose 100 * intersection >= percent * union.

    apart: sides per set; only pairs that differ in every one of them count.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2 and not apart:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
    owner = np.repeat(np.arange(m), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posts = owner[order]
    start = np.append(0, np.cumsum(np.bincount(ids)))
    root = np.arange(m)
    links = []
    ends = np.append(0, np.cumsum(size))
    for i in range(m):
        other = root != root[i]
        for side in apart:
            other &= side != side[i]
        if not other.any():
            continue
        mine = ids[ends[i] : ends[i + 1]]
        lo, hi = start[mine], start[mine + 1]
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(posts[at], minlength=m)
        for j in np.flatnonzero(other & (100 * both >= percent * (size + size[i] - both))):
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def signature_links(sig: np.ndarray, least: int, *apart: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in at least ``least`` values; only pairs that differ in every one of ``apart``."""
    m = len(sig)
    root = np.arange(m)
    links = []
    for i in range(m):
        other = root != root[i]
        for side in apart:
            other &= side != side[i]
        rest = np.flatnonzero(other)
        if not len(rest):
            continue
        for j in rest[(sig[rest] == sig[i]).sum(axis=1) >= least]:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys, across Arrow batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.zeros(batch.num_rows - 1, bool) if batch.num_rows > 1 else np.zeros(0, bool)
        columns = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        for c in columns:
            marks |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(marks) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _blocks(df: DataFrame, key: list[str], size_col: str, member: str, block: int) -> DataFrame:
    """Rows copied to the square blocks of their group that hold them: columns bi <= bj, side (own block)."""
    nb = F.ceil(F.col(size_col) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member)), nb).cast("int")
    df = df.withColumn("side", own).withColumn("__other", F.explode(F.sequence(F.lit(0), nb - 1)))
    return df.withColumn("bi", F.least("side", "__other")).withColumn("bj", F.greatest("side", "__other")).drop("__other")


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int) -> DataFrame:
    """id, th (text hash), n_shingles, k1, k2 (the set's digest) and the label values, per document."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        a, b = _multipliers(trees * DEPTH)
        cache = TokenHashes()
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for text in binary_list(batch.column("text")):
                s = shingles(split(text), cache, words)
                n.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                k1.append(int.from_bytes(d[:8], "little", signed=True)), k2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s, a, b).astype(">u2").view(">i8").astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["id", "th", "n_shingles", "k1", "k2", "sig"])

    return base.mapInArrow(lambda batches: tidy(run(batches)), "id long, th long, n_shingles long, k1 long, k2 long, sig array<long>")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("t", "p1", "p2").agg(F.count("*").alias("size")).where("size >= 2"), ["t", "p1", "p2"])


def labelled(classes: DataFrame) -> DataFrame:
    """(t, p1, p2, id, size): members of each label's region of at least two."""
    return _sized(classes.select("id", F.posexplode("sig").alias("t", "p1")).withColumn("p2", F.lit(0).cast("long")))


def deepened(crowded: DataFrame, classes: DataFrame, labels: int, ring: tuple[int, ...]) -> DataFrame:
    """``crowded`` (id, t, p1, others) by the region's label and, in turn, each of the labels ``ring`` places on: t, p2."""
    others = [c for c in crowded.columns if c != "t"]
    on = F.transform(F.array(*[F.lit(d) for d in ring]), lambda d: F.struct((F.col("t") + labels * d).alias("t"), F.get("sig", (F.col("t") + d) % labels).alias("p2")))
    return crowded.join(classes.select("id", "sig"), "id").select(*others, F.explode(on).alias("x")).select(*others, "x.t", "x.p2")


def regions(classes: DataFrame, trees: int, crowd: int, ring: tuple[int, ...] = RING, rows: DataFrame | None = None) -> DataFrame:
    """(t, p1, p2, depth, size, id): members of each region of at least two, at its adaptive depth."""
    rows = labelled(classes) if rows is None else rows
    out = lambda df, depth: df.select("t", "p1", "p2", F.lit(depth).alias("depth"), "size", "id")
    deeper = _sized(deepened(rows.where(F.col("size") > crowd).select("id", "t", "p1"), classes, 2 * trees, ring))
    return out(rows.where(F.col("size") <= crowd), 4).unionByName(out(deeper, 8))


def clustered(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rows`` with each member's candidate cluster, its own id if it is in none."""
    return rows.join(clusters, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "id")).drop("node", "component")


def strays(crowded: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of crowded regions that more than one cluster meets in: cluster, whether it is a stray (not of the region's largest cluster), and how many are."""
    found = clustered(crowded, clusters)
    parts = found.groupBy("t", "p1", "cluster").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("t", "p1").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("all")).where("all > top.n").select("t", "p1", F.col("top.cluster").alias("top"), (F.col("all") - F.col("top.n")).alias("strays"))
    return found.join(mixed, ["t", "p1"]).withColumn("stray", F.col("cluster") != F.col("top")).drop("top")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, trees: int = TREES, crowd: int = CROWD, block: int = BLOCK, share: int = SHARE, text_hash: bool = False) -> DataFrame:
    """Per document: id, n_shingles, component_id and kept; with ``text_hash``, its text's xxhash64 as ``th`` too."""
    m = trees * DEPTH
    t = percent / 100
    least = max(1, int(m * max(0.0, t - 4.2 * (t * (1 - t) / m) ** 0.5)))
    sketched = materialize(sketch(docs, id_col, text_col, words, trees), "sketches")
    live = sketched.where("n_shingles > 0 and id is not null")
    classes = live.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("least"), F.first("sig").alias("sig")).select(F.col("k1").alias("id"), "k1", "k2", F.col("least.id").alias("doc"), F.col("least.th").alias("th"), "sig")
    classes = materialize(classes, "classes")

    # candidate clusters from the forest
    rows = materialize(labelled(classes), "labels")
    keys = ["t", "p1", "p2", "bi", "bj"]

    def sift(batches):
        found: set[tuple[int, int]] = set()
        for run in runs(batches, keys):
            ids = run.column("id").to_pylist()
            sig = np.stack(run.column("sig").to_numpy(zero_copy_only=False)).view(np.uint16)
            apart = [run.column("cluster").to_numpy()] if run.column("cluster").null_count == 0 else []
            if run.column("bi")[0].as_py() != run.column("bj")[0].as_py():
                apart.append(run.column("side").to_numpy())
            found.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in signature_links(sig, least, *apart))
            if len(found) > 1 << 18:
                yield _edges(list(found))
                found.clear()
        yield _edges(list(found))

    def sifted(member: DataFrame) -> DataFrame:
        """Links of what is dealt: (t, p1, p2, bi, bj, side, cluster, id)."""
        with_sig = member.join(classes.select("id", "sig"), "id")
        links = with_sig.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "cluster", "id", "sig").mapInArrow(lambda batches: tidy(sift(batches)), "a long, b long")
        return materialize(links, "links")

    def spread(member: DataFrame, everywhere) -> DataFrame:
        """A region's members dealt over blocks, some of them to every block."""
        nb = F.ceil(F.col("size") / F.lit(block)).cast("int")
        own = F.array(F.pmod(F.xxhash64("id"), nb).cast("int"))
        member = member.withColumn("bi", F.explode(F.when(everywhere, F.sequence(F.lit(0), nb - 1)).otherwise(own)))
        return member.withColumns({"bj": F.col("bi"), "side": F.col("bi")})

    none = F.lit(None).cast("long")
    crowded = rows.where(F.col("size") > crowd)
    near = sifted(_blocks(rows.where(F.col("size") <= crowd).withColumn("cluster", none), ["t", "p1"], "size", "id", block))
    # crowded regions: all with the region's first, then the strays with all
    first = crowded.groupBy("t", "p1").agg(F.min("id").alias("first"))
    star = crowded.join(first, ["t", "p1"]).withColumn("cluster", (F.col("id") == F.col("first")).cast("long"))
    near = near.unionByName(sifted(spread(star, F.col("cluster") == 1)))
    clusters = components(near)
    apart = materialize(strays(crowded, clusters), "strays")
    if not apart.isEmpty():
        few = (F.col("strays") <= crowd) | (F.col("size") <= block)
        near = near.unionByName(sifted(spread(apart.where(few), F.col("stray"))))
        many = apart.where(~few).select(*rows.columns)
        for k in range(0, len(RING) if percent < 85 else 3, STEP) if not many.isEmpty() else ():
            # too many of them: deeper regions, a few places at a time, where they can join clusters that are still apart
            clusters = components(near)
            deep = clustered(regions(classes, trees, crowd, RING[k : k + STEP], many).where("depth = 8").drop("size"), clusters)
            met = deep.groupBy("t", "p1", "p2").agg(F.count("*").alias("size"), F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").drop("a", "b")
            near = near.unionByName(sifted(_blocks(deep.join(met, ["t", "p1", "p2"]), ["t", "p1", "p2"], "size", "id", block)))
        clusters = components(near)

    # confirm on the full sets
    clusters = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("size")), "component")
    involved = materialize(clusters.join(classes.select("id", "doc", "th"), clusters["node"] == classes["id"]).select("id", "doc", "th", F.col("component").alias("cluster"), "size"), "clusters")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    keys2 = ["cluster", "bi", "bj"]

    def confirm(batches):
        cache = TokenHashes()
        for run in runs(batches, keys2):
            rows = dict(zip(run.column("id").to_pylist(), zip(binary_list(run.column("text").combine_chunks()), run.column("side").to_pylist(), run.column("part").to_pylist())))
            ids = list(rows)
            if len(ids) < 2:
                continue
            sets = [shingles(split(text), cache, words) for text, _, _ in rows.values()]
            apart = [np.array([x[2] for x in rows.values()])] if run.column("part").null_count == 0 else []
            if run.column("bi")[0].as_py() != run.column("bj")[0].as_py():
                apart.append(np.array([x[1] for x in rows.values()]))
            links = jaccard_links(sets, percent, *apart)
            if links:
                yield _edges([(ids[i], ids[j]) for i, j in links])

    def confirmed(dealt: DataFrame) -> DataFrame:
        """Links of what is dealt: (id, doc, th, cluster, bi, bj, side, part). It goes to the texts while it is few rows, which are counted."""
        dealt = materialize(dealt, "dealt")
        dealt = F.broadcast(dealt) if dealt.count() <= SENT else dealt
        with_text = texts.join(dealt, ["doc", "th"]).select(*keys2, "side", "part", "id", "text")
        return with_text.repartition(*keys2).sortWithinPartitions(*keys2).mapInArrow(lambda batches: tidy(confirm(batches)), "a long, b long")

    none = F.lit(None).cast("long").alias("part")
    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(share)).cast("int")).cast("int")
    links = confirmed(involved.select("id", "doc", "th", "cluster", own.alias("bi"), own.alias("bj"), own.alias("side"), none))
    large = involved.where(F.col("size") > share)
    if not large.isEmpty():
        links = materialize(links, "links")

        def parted() -> DataFrame:
            parts = components(links)
            return large.drop("size").join(parts, F.col("id") == F.col("node"), "left").select("id", "doc", "th", "cluster", F.coalesce("component", "id").alias("part"))

        # one text of each part against those of the cluster's other parts
        heads = parted().where("id = part")
        heads = heads.join(heads.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1"), "cluster")
        links = links.unionByName(materialize(confirmed(_blocks(heads.withColumn("part", F.col("id")), ["cluster"], "size", "id", share).drop("size")), "links"))
        # what is still apart: strays against all, the largest part against the strays
        members = materialize(parted(), "parts")
        sizes = members.groupBy("cluster", "part").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("cluster").agg(F.sum("n").alias("size"), F.max(F.struct("n", "part")).alias("top")).where("size > top.n").select("cluster", F.col("top.part").alias("top"), (F.col("size") - F.col("top.n")).alias("strays"), F.col("top.n").alias("rest"))
        blocks = lambda c: F.ceil(F.col(c) / F.lit(share)).cast("int")
        open_ = members.join(sizes, "cluster").withColumns({"ns": blocks("strays"), "nr": blocks("rest"), "stray": F.col("part") != F.col("top")})
        side = F.when(F.col("stray"), F.pmod(F.xxhash64("id"), F.col("ns"))).otherwise(F.col("ns") + F.pmod(F.xxhash64("id"), F.col("nr"))).cast("int")
        open_ = open_.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("stray"), F.col("ns") + F.col("nr")).otherwise(F.col("ns")) - 1)))
        open_ = open_.select("id", "doc", "th", "cluster", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "part")
        links = links.unionByName(confirmed(open_))
    linked = components(links)

    node = F.coalesce("component", "id")
    members = classes.join(linked, classes["id"] == linked["node"], "left").select("k1", "k2", "doc", node.alias("component"))
    # a component's name is its least document id
    groups = members.join(members.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("k1", "k2", "component_id")
    out = sketched.join(groups, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), *(["th"] if text_hash else []))

"""Benchmark decontamination by winnowing (Schleimer, Wilkerson & Aiken 2003).

Texts become words: A-Z lower-cased, then maximal runs of digits, letters a-z
and non-ASCII characters. Of every ``span - k + 1`` consecutive k-grams the one
with the least hash is a fingerprint, so any shared run of ``span`` words
shares one. Fingerprints of documents meet those of the test items, and every
meeting is extended over the windows of ``span`` words that hold it: those that
stand in an item are hits. A window is looked up by its hash and its words, so
the cost follows the text, however often a word or passage repeats in it or in
the items. Items of fewer words are one window of their own length and use
every gram of that length as fingerprint.

Two plans, the same results. While the test items' text is no more than
``broadcast_words`` words (it is summed first), the items travel to the
documents and nothing is shuffled; words are compared one by one. Beyond it,
the documents' distinct fingerprints meet those of the items in a semi-join,
the windows round them meet the items' windows in a join on 128 hash bits, and
each document gets back the windows hit and the names of their items.

Null or empty texts have no words; an item without words matches nothing;
repeated items count each by its id (a repeated item_id counts once); null
item_ids are left out of the lists. Repeated rows have one answer each. Texts
of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenHashes, U64, binary_list, mix64, ngram_hashes, tidy

SPAN, K = 10, 5
BROADCAST_WORDS = 4_000_000
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))
_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost least hash of each window of ``w`` grams."""
    m = len(grams) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    return np.unique(len(grams) - 1 - (windows.argmin(axis=1) + np.arange(m)))


def marked(grams: np.ndarray, known: np.ndarray, span: int, k: int) -> np.ndarray:
    """Starts of the windows of ``span`` words that hold a fingerprint found in ``known`` (sorted)."""
    at = winnow(grams, span - k + 1)
    at = at[_among(grams[at], known) >= 0]
    n = len(grams) + k - span  # windows
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, np.maximum(at - (span - k), 0), 1)
    np.add.at(inside, np.minimum(at, n - 1) + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, -1 where it is not there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _cover(n: int, starts: np.ndarray, span: int, hit: np.ndarray) -> None:
    """Flag the words of the windows at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    hit |= np.cumsum(edge[:-1]) > 0


class Items:
    """The test items' windows and fingerprints, ready to meet documents."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        self.names, self.ids = [], {}
        seen, windows, prints = set(), defaultdict(list), [np.empty(0, U64)]
        coded = []
        for name, words in items:
            if words and (name, tuple(words)) not in seen:
                seen.add((name, tuple(words)))
                self.names.append(name)
                coded.append(np.array([self.ids.setdefault(x, len(self.ids)) for x in words], np.int32))
        self.hash = np.append(TokenHashes().array(list(self.ids)), U64(0))
        for i, c in enumerate(coded):
            n = min(span, len(c))
            h, first = np.unique(ngram_hashes(self.hash[c], n), return_index=True)
            windows[n].append((h, np.full(len(h), i, np.int32), first.astype(np.int32)))
            if len(c) >= span:
                g = ngram_hashes(self.hash[c], k)
                prints.append(g[winnow(g, span - k + 1)])
        self.coded = coded
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {}
        for n, parts in windows.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.windows[n] = h[order], item[order], at[order]

    def meet(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """A flag for each word, and the items met."""
        n = len(words)
        hit, met = np.zeros(n, bool), set()
        if not n or not self.windows:
            return hit, met
        get = self.ids.get
        doc = np.fromiter((get(x, -1) for x in words), np.int64, n)
        known = np.concatenate([[0], (doc >= 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        for lo, hi in zip(edges[::2], edges[1::2]):  # only stretches of known words can hold a window
            for size in self.windows:
                if hi - lo >= size:
                    self._meet(doc[lo:hi], size, hit[lo:hi], met)
        return hit, met

    def _meet(self, doc, size, hit, met) -> None:
        starts = marked(ngram_hashes(self.hash[doc], self.k), self.prints, size, self.k) if size == self.span else np.arange(len(doc) - size + 1)
        if not len(starts):
            return
        grams = ngram_hashes(self.hash[doc], size)[starts]
        h, item, at = self.windows[size]
        place = _among(grams, h)
        found = starts[place >= 0]
        if not len(found):
            return
        # each distinct window is compared word by word, once with every item that may hold it
        _, first, which = np.unique(grams[place >= 0], return_index=True, return_inverse=True)
        same = np.zeros(len(first), bool)
        for j, s in enumerate(found[first]):
            window = doc[s : s + size]
            g = int(grams[place >= 0][first[j]])
            for e in range(np.searchsorted(h, U64(g)), np.searchsorted(h, U64(g), "right")):
                if np.array_equal(self.coded[item[e]][at[e] : at[e] + size], window):
                    same[j] = True
                    met.add(int(item[e]))
        if same.any():
            _cover(len(doc), found[same[which]], size, hit)


def _runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _answer(items: Items, text: bytes) -> tuple:
    words = words_of(text)
    hit, met = items.meet(words)
    return _told(hit, {items.names[i] for i in met})


def _told(hit: np.ndarray, names: set) -> tuple:
    names = sorted(names - {None})
    n = int(hit.sum())
    return len(hit), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0, _runs(hit) if n else [], names


_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_words", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _with(batch: pa.RecordBatch, rows: list[tuple], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in drop]
    columns = [batch.column(n) for n in keep] + [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)]
    return pa.RecordBatch.from_arrays(columns, names=keep + _OUT.names)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, broadcast_words: int = BROADCAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the columns of ``keep``, word and hit counts, the hit word runs and the items met."""
    assert 1 <= k <= span
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *keep])], F.col(f"`{text_col}`").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"] + [_SCHEMA])
    items = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("words"))
    size = items.agg(F.sum(F.length("words"))).first()[0] or 0
    if size <= 6 * broadcast_words:  # six characters a word at least: a bound on what is sent
        sent = docs.sparkSession.sparkContext.broadcast([(r["item"], r["words"]) for r in items.toLocalIterator()])

        def near(batches):
            mine = Items(((name, words_of(text.encode())) for name, text in sent.value), span, k)
            for batch in batches:
                yield _with(batch, [_answer(mine, t) for t in binary_list(batch.column("__text"))], ("__text",))

        return base.mapInArrow(lambda batches: tidy(near(batches)), out)

    # beyond the bound; rows alike in id and text share their key and their answer
    key = F.md5(F.concat_ws("\x00", F.col(f"`{id_col}`").cast("string"), F.col("__text")).cast("binary"))
    base = base.withColumn("__row", key)
    lengths = sorted(r[0] for r in items.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in binary_list(b.column("words"))], pa.int32())], names=["n"]) for b in bs), "n int").where(f"n between 1 and {span - 1}").distinct().collect())  # fewer than span

    def hashes(h: np.ndarray, n: int) -> np.ndarray:
        """Two hashes of each window of ``n`` words, as one 128-bit value a row."""
        return np.column_stack([ngram_hashes(h, n) ^ U64(n), ngram_hashes(mix64(h ^ U64(0xA5A5A5A5A5A5A5A5)), n)])

    def prints(batches, key):
        cache = TokenHashes()
        for batch in batches:
            keys, found = [], []
            for name, text in zip(batch.column(key).to_pylist(), binary_list(batch.column("__text" if key == "__row" else "words"))):
                g = ngram_hashes(cache.array(words_of(text)), k)
                g = np.unique(g[winnow(g, span - k + 1)])
                keys += [name] * len(g)
                found.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate([*found, np.empty(0, U64)]).view(np.int64))], names=["row", "h"])

    def item_windows(batches):
        cache = TokenHashes()
        for batch in batches:
            keys, found = [], []
            for name, text in zip(batch.column("item").to_pylist(), binary_list(batch.column("words"))):
                h = cache.array(words_of(text))
                if len(h):
                    w = np.unique(hashes(h, min(span, len(h))), axis=0)
                    keys += [name] * len(w)
                    found.append(w)
            w = np.concatenate([*found, np.empty((0, 2), U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], names=["item", "w1", "w2"])

    def starts_of(h: np.ndarray, size: int, found: list) -> np.ndarray:
        if size < span:
            return np.arange(max(0, len(h) - size + 1))
        return marked(ngram_hashes(h, k), np.sort(np.array(found, np.int64).view(U64)), span, k) if found and len(h) >= span else np.arange(0)

    def doc_windows(batches):
        cache = TokenHashes()
        for batch in batches:
            for row, text, found in zip(batch.column("__row").to_pylist(), binary_list(batch.column("__text")), batch.column("__found").to_pylist()):
                h = cache.array(words_of(text))
                some = [hashes(h, n)[starts_of(h, n, found)] for n in (*lengths, span) if len(h) >= n]
                w = np.unique(np.concatenate([*some, np.empty((0, 2), U64)]), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(w), pa.string()), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], names=["row", "w1", "w2"])

    have = items.mapInArrow(lambda bs: prints(bs, "item"), "row string, h long").select("h").distinct()
    left = base.select("__row", "__text").mapInArrow(lambda bs: prints(bs, "__row"), "row string, h long")
    found = left.join(have, "h", "left_semi").groupBy(F.col("row").alias("__row")).agg(F.collect_set("h").alias("__found"))
    base = base.join(found, "__row", "left")
    met = base.select("__row", "__text", "__found").mapInArrow(doc_windows, "row string, w1 long, w2 long")
    met = met.join(items.mapInArrow(item_windows, "item string, w1 long, w2 long"), ["w1", "w2"]).groupBy(F.col("row").alias("__row"))
    met = met.agg(F.collect_set(F.struct("w1", "w2")).alias("__hits"), F.collect_set("item").alias("__items"))

    def far(batches):
        cache = TokenHashes()
        for batch in batches:
            rows = []
            for text, found, hits, names in zip(binary_list(batch.column("__text")), *(batch.column(c).to_pylist() for c in ("__found", "__hits", "__items"))):
                h = cache.array(words_of(text))
                hit, want = np.zeros(len(h), bool), {(x["w1"], x["w2"]) for x in hits or ()}
                for n in (*lengths, span) if want else ():
                    s = starts_of(h, n, found) if len(h) >= n else np.arange(0)
                    w = hashes(h, n)[s].view(np.int64).tolist() if len(s) else []
                    _cover(len(h), s[[tuple(x) in want for x in w]] if len(s) else s, n, hit)
                rows.append(_told(hit, set(names or ())))
            yield _with(batch, rows, ("__text", "__found", "__hits", "__items", "__row"))

    return base.join(met, "__row", "left").mapInArrow(far, out)

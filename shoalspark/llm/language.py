"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte 1-, 2- and 3-grams (ASCII lower-cased, white
space runs as one space). The presence kernel of two texts is the number of
grams they share, each order normalised by the geometric mean of the set
sizes, averaged over the orders. Nystroem landmarks turn the kernel into
``landmarks`` features, on which one-versus-rest kernel ridge regression is
solved; whole batches of texts are scored by two matrix products.

The classifier is fitted on at most ``per_class`` different labelled texts of
each language, those of least hash (a documented bound: the fit needs no more).
What the driver holds is bounded in bytes too, by fewer texts: a language's
texts are taken, the shorter first, while they come to ``fit_chars`` characters
together, one in any case. Texts of every length are used whole, in fitting and scoring.

Texts that are null or hold no letter are ``und`` with score 0, as is every
text if nothing was learned. Ties between languages go to the first in sorted
order. With one learned language every text with a letter gets it, score 1.
Columns of ``docs`` named lang_pred or score give way to the result's. Repeated
rows are learned from once and predicted each.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_list, materialize, tidy

PER_CLASS, LANDMARKS, RIDGE, FIT_CHARS = 300, 160, 1e-2, 4_000_000
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else (0x20 if c in (9, 10, 11, 12, 13) else c) for c in range(256))
_SIZES = (1 << 8, 1 << 16, 1 << 24)


def gram_codes(text: bytes) -> list[np.ndarray]:
    """Distinct byte grams of order 1, 2 and 3, as numbers."""
    b = np.frombuffer(text.translate(_FOLD), np.uint8).astype(np.int32)
    if len(b) > 1:
        b = b[np.append(True, ~((b[1:] == 32) & (b[:-1] == 32)))]
    out = []
    code = b
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << 8) | b[n - 1 :]
        out.append(_distinct(code, n))
    return out


@functools.cache
def _flags(n: int) -> np.ndarray:
    return np.zeros(_SIZES[n - 1], bool)


def _distinct(code: np.ndarray, n: int) -> np.ndarray:
    """np.unique without order: the first writer of each slot in a reused table stays."""
    if not len(code):
        return code
    if len(code) < 256:
        return np.unique(code)
    seen = _flags(n)
    if n < 3:
        seen[code] = True
        got = np.flatnonzero(seen)
        seen[code] = False
        return got
    slot = _slots()
    slot[code] = np.arange(len(code), dtype=np.int32)
    return code[slot[code] == np.arange(len(code), dtype=np.int32)]


@functools.cache
def _slots() -> np.ndarray:
    return np.zeros(_SIZES[2], np.int32)


class Kernel:
    """Kernel values against fixed landmark texts."""

    def __init__(self, marks: list[bytes]):
        sets = [gram_codes(t) for t in marks]
        self.size, self.vocab, self.rows = [], [], []
        for n in range(3):
            codes = np.unique(np.concatenate([s[n] for s in sets])) if sets else np.empty(0, np.int32)
            index = np.full(_SIZES[n], -1, np.int32)
            index[codes] = np.arange(len(codes), dtype=np.int32)
            rows = np.zeros((len(codes), len(sets)), np.float32)
            for j, s in enumerate(sets):
                rows[index[s[n]], j] = 1 / np.sqrt(max(1, len(s[n])))
            self.vocab.append(index)
            self.rows.append(rows)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.rows[0].shape[1]))
        for at in range(0, len(texts), 64):
            part = [gram_codes(t) for t in texts[at : at + 64]]
            for n in range(3):
                x = np.zeros((len(part), len(self.rows[n])), np.float32)
                for i, s in enumerate(part):
                    k = self.vocab[n][s[n]]
                    x[i, k[k >= 0]] = 1 / np.sqrt(max(1, len(s[n])))
                out[at : at + len(part)] += x @ self.rows[n] / 3
        return out


def fit(texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Landmarks spread evenly over the classes; primal ridge on Nystroem features."""
    classes = sorted(set(langs))
    if not classes:
        return {"classes": [], "marks": [], "weights": np.zeros((0, 0))}
    by = {c: [i for i, x in enumerate(langs) if x == c] for c in classes}
    chosen = [i for c in classes for i in by[c][: max(1, landmarks // len(classes))]]
    marks = [texts[i] for i in chosen]
    kernel = Kernel(marks)
    k_mm = kernel(marks)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel(texts) @ half, np.ones((len(texts), 1))])
    y = np.array([[1.0 if x == c else -1.0 for c in classes] for x in langs])
    balance = np.array([len(langs) / (len(classes) * len(by[x])) for x in langs])[:, None]
    w = np.linalg.solve(phi.T @ (balance * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (balance * y))
    return {"classes": classes, "marks": marks, "weights": np.vstack([half @ w[:-1], w[-1:]])}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where=None, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, ridge: float = RIDGE, fit_chars: int = FIT_CHARS) -> dict:
    """Fit on a bounded sample: of each language the ``per_class`` different texts of least hash, up to ``fit_chars`` characters."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    rows = rows.where(where(F.col("id"))) if where is not None else rows
    # lengths first: a hash threshold a language leaves a little more than the bound of its different texts, the exact
    # cut is made on those; then the texts of the chosen
    marks = rows.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    some = marks.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("of"), F.min("h").alias("least"))
    share = F.least(F.lit(1.0), 1.1 * (per_class + 4 * per_class**0.5) / F.col("of"))
    some = materialize(some.select("lang", "least", share.alias("share")), "languages")
    near = (F.col("h") / F.lit(2.0**64) + 0.5 < F.col("share")) | (F.col("h") == F.col("least"))
    first = marks.join(some, "lang").where(near).groupBy("lang", "h").agg(F.min("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy("h")
    first = first.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_class)
    short = Window.partitionBy("lang").orderBy("n", "h")  # the shorter first, where not all fit
    first = first.withColumns({"k": F.row_number().over(short), "sum": F.sum("n").over(short)}).where((F.col("k") == 1) | (F.col("sum") <= fit_chars))
    wanted = {(r["lang"], r["h"]) for r in first.select("lang", "h").collect()}
    if not wanted:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(wanted), "lang string, h long")
    got = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # per_class rows a language
    texts, langs = [], []
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["h"])):
        if _LETTER.search(r["text"]):
            texts.append(r["text"].encode())
            langs.append(r["lang"])
    return fit(texts, langs, landmarks, ridge)


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; the text is the only input of a prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])

    def run(batches):
        m = sent.value
        kernel = Kernel(m["marks"]) if m["classes"] else None
        for batch in batches:
            column = batch.column(text_col)
            n = batch.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            texts = binary_list(column)
            live = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))] if kernel else []
            for at in range(0, len(live), 512):
                part = live[at : at + 512]
                k = kernel([texts[i] for i in part])
                margin = k @ m["weights"][:-1] + m["weights"][-1]
                e = np.exp(3.0 * (margin - margin.max(axis=1, keepdims=True)))
                best = margin.argmax(axis=1)
                for i, b, s in zip(part, best, e[np.arange(len(part)), best] / e.sum(axis=1)):
                    pred[i], score[i] = m["classes"][b], float(min(1.0, max(0.0, s)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lambda batches: tidy(run(batches)), schema)

"""Fill-in-the-middle: a text cut at two token boundaries and put together anew, middle last.

A token is a run of ASCII letters or any other single code point. Each text
becomes an array of code points (UTF-32), whose classes are compared with
their neighbours'; where they differ, or where the class is not letters,
a token begins. The two chosen ranks index these beginnings, and the pieces
are slices of the array. Which ranks and which form a row gets follows from its
id alone, so a job run twice gives the same output.

Rows are independent: one pass in Arrow batches, nothing is shuffled. A text is
held whole, at four bytes a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_list, reachable, tidy

SENTINELS = ("<P>", "<S>", "<M>")
#: Columns that transform() adds.
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(raw: bytes) -> np.ndarray:
    """Code points of UTF-8; bytes that are none stand for themselves, so that they come back as they were."""
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def utf8(points: np.ndarray) -> bytes:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def token_starts(points: np.ndarray) -> np.ndarray:
    """Places where a token begins."""
    low = points | 0x20  # folds A-Z on a-z, and nothing else on them
    letter = (low >= 0x61) & (low <= 0x7A)
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def draws(doc_id, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers of an id (null: no digits)."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _cut(raw: bytes, doc_id, seed: str, plain_percent: int, spm_percent: int, marks: Sequence[bytes]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = code_points(raw)
    starts = token_starts(points)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= 100 - plain_percent or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    ends = np.append(starts, len(points))
    a, b = sorted((int(ends[h1 % (n + 1)]), int(ends[h2 % (n + 1)])))
    prefix, middle, suffix = utf8(points[:a]), utf8(points[a:b]), utf8(points[b:])
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def _meet(a: str, b: str) -> bool:
    """Whether ``a`` holds ``b``, or ends as ``b`` begins."""
    return (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ("doc_id",), seed: str = "1:", plain_percent: int = 10, spm_percent: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Columns ``keep`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    psm: first, prefix, second, suffix, third, middle; spm: second, suffix, first, prefix, third, middle. A text
    that is null, empty or holds a sentinel stays plain, as do ``plain_percent`` of the others; of the rest,
    ``spm_percent`` take the second form. Ids may repeat or be null: rows of one id draw the same numbers, and
    nulls share theirs. Bytes that are no UTF-8 pass through unchanged. The added columns replace kept ones of
    their names.
    """
    if len(set(sentinels)) != 3 or not all(sentinels) or any(_meet(a, b) for a in sentinels for b in sentinels):
        raise ValueError("three different sentinels are needed, none within another, none beginning as one ends")
    reachable(docs.sparkSession)
    marks = [x.encode() for x in sentinels]
    keep = [c for c in keep if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("string").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    kept = [f for f in base.schema if f.name not in ("__id", "__text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ADDED])

    def run(batches):
        for b in batches:
            rows = [_cut(raw, i, seed, plain_percent, spm_percent, marks) for raw, i in zip(binary_list(b.column("__text")), b.column("__id").to_pylist())]
            n, form, pre, mid, out = zip(*rows) if rows else ((),) * 5
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), "n", "form", "prefix_chars", "middle_chars", "output"])

    return base.mapInArrow(lambda bs: tidy(run(bs)), schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text an output was made of, from the output and its form alone.

    The first occurrence of each sentinel is the one that was put there: no piece holds one, and none can begin in
    a piece and end in the sentinel behind it, since none begins as another ends.
    """
    p, s, m = (F.lit(x) for x in sentinels)

    def parts(first: Column, second: Column) -> tuple[Column, Column, Column]:
        begin, cut, last = F.length(first) + 1, F.instr(output, second), F.instr(output, m)
        return F.substring(output, begin, cut - begin), F.substring(output, cut + F.length(second), last - cut - F.length(second)), F.substring(output, last + F.length(m), F.length(output))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)

"""Token counts with the whole-token shortcut.

Offline, once on the driver: every vocabulary string is encoded alone by the
library; those that come out as one token are proven. A text is split into
the model's pre-tokens; a proven pre-token counts one without merging, and
only the rest are merged by the library (each distinct one once, remembered
in a bounded table). Added special strings inside a text are one token each,
as the library's default has it.

The split uses a pattern engine of its own, whose character classes are held
against the library's for every code point when a worker starts; texts with a
code point on which they differ are counted by the library itself. Null texts
are empty: no bytes, no tokens. Every row gives a row.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000
WINDOW = 1 << 20


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (c for c in range(256) if c not in plain)
    letters = {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(rest)}
    return [letters[c] for c in range(256)]


class _Merged(dict):
    """Tokens of a pre-token: proven ones are there from the start, others are merged when first seen."""

    def __init__(self, model, proven: list[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.model, self.proven = model, dict.fromkeys(proven, 1)
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(self.proven)
        if len(piece) <= 64:
            self[piece] = n
        return n


@functools.cache
def prove(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and one token when encoded alone."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pattern = regex.compile(public_tokenizers.PATTERN)
    marks = set(tokenizer.get_added_tokens_decoder()[i].content for i in tokenizer.get_added_tokens_decoder())
    strings = (tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(False)))
    strings = [s for s in dict.fromkeys(strings) if s and "\ufffd" not in s and s not in marks and pattern.fullmatch(s)]
    alone = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, alone) if len(e.ids) == 1]


class Counter:
    """Counts tokens as the library does, for a byte-level BPE model with the library's own pre-token pattern."""

    def __init__(self, path: str, proven: list[str]):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model["pre_tokenizer"] or {}
        assert pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model["normalizer"], "only plain byte-level models"
        added = model["added_tokens"]
        assert not any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added), "plain added tokens only"
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.marks = [a["content"] for a in added]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.checked = set(map(chr, range(0x80)))
        self.odd: set[str] = {c for c in self.checked if self._differs(c)}
        self.count_of = _Merged(self.tokenizer.model, proven)

    def _differs(self, c: str) -> bool:
        """Whether the two pattern engines class a character apart: the cuts between other classes tell."""
        probe = f"a{c}1{c}!\n"
        return [x for _, x in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] != [m.span() for m in self.pattern.finditer(probe)]

    def _odd(self, text: str) -> bool:
        chars = set(text)
        new = chars - self.checked
        if new:
            self.checked |= new
            self.odd |= {c for c in new if self._differs(c)}
        return bool(self.odd) and not self.odd.isdisjoint(chars)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if (self.odd or not text.isascii()) and self._odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is not None and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if len(text) <= WINDOW:
            return sum(map(self.count_of.__getitem__, self.pattern.findall(text)))
        return sum(self.count_of[m.group()] for m in self.pattern.finditer(text))


_counters: dict[str, Counter] = {}


def counter(path: str, proven: list[str]) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, proven)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = (), limit: int = 512) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_tokens and over_limit."""
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"] + ["n_bytes long, n_tokens long, over_limit boolean"])

    sent = docs.sparkSession.sparkContext.broadcast(prove(path))  # bounded by the vocabulary

    def run(batches):
        c = counter(path, sent.value)
        for b in batches:
            texts = b.column("__text").to_pylist()
            n = [c.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            cols = [b.column(x) for x in b.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*(x for x in b.schema.names if x != "__text"), "n_bytes", "n_tokens", "over_limit"])

    return base.mapInArrow(run, out)

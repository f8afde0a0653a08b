import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from shoalspark.llm import bpe, tokencount

from .helpers import ODD, docs

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def _texts():
    rng = random.Random(5)
    words = ["the", "Ünder", "it's", "  ", "\n\n", "12345", "???", "naïve", "\t", "'ll", " \n x", "日本語"]
    return [*ODD, *("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n)) for n in (10, 200, 3000)), "z" * 5000 + " end", "  \n" * 2000 + "b"]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (256, 64)])
def test_encode_as_the_library(spark, chunk, overlap):
    texts = _texts()
    enc = bpe.encoding(RANKS)
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), RANKS, keep=("doc_id",), chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), (i, t)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_texts_are_stitched_not_only_encoded_whole(spark):
    long = docs(spark, [" ".join(f"w{i}" for i in range(900))]).selectExpr("1L as __row", "text as __text")
    pieces, rest = bpe._pieces(long, RANKS, 256, 64)
    assert pieces.count() > 5 and rest.count() == 0


def test_round_trip(spark):
    texts = _texts()
    back = bpe.decode(bpe.encode(docs(spark, texts), RANKS, keep=("doc_id",), chunk=256, overlap=64, ids=True), RANKS)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert bpe.encode(docs(spark, []), RANKS, keep=("doc_id",)).count() == 0
    assert tokencount.count_tokens(docs(spark, []), P.path("byte_bpe_50k.json"), keep=("doc_id",)).count() == 0


def test_counts_as_the_library(spark):
    texts = [*_texts(), "a<|endoftext|><|endoftext|>b", "\x1c\x1d x\x85y", "ſ'ſ it'S", "ఝ౜ ა0 \U00011dd9", "word " * 600]
    path = P.path("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs(spark, texts), path, keep=("doc_id",)).collect()}
    lib = tokencount.counter(path, tokencount.prove(path)).tokenizer
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), (i, t)


def test_only_pairs_that_do_not_resynchronise_are_put_together(spark):
    text = " ".join(f"w{i}" for i in range(400)) + " " + "z" * 1500 + " " + " ".join(f"v{i}" for i in range(400))
    rows = docs(spark, [text, text, "y" * 3000])
    long = rows.selectExpr("doc_id as __row", "text as __text")
    pieces, several = bpe._pieces(long, RANKS, 256, 64)
    by = {r["row"]: r["n"] for r in pieces.groupBy("row").agg(F.count("*").alias("n")).collect()}
    assert by[0] == by[1] > 15 and by[2] == 1 and several.where("row = 0").count() == 1
    enc = bpe.encoding(RANKS)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(rows, RANKS, keep=("doc_id",), chunk=256, overlap=64, ids=True).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate([text, text, "y" * 3000])}


def test_repeated_rows_and_very_long_texts_are_counted_each(spark):
    df = docs(spark, ["word " * 50_000, "z" * 60_000, "a"])
    got = tokencount.count_tokens(df.unionByName(df), P.path("byte_bpe_50k.json"), keep=("doc_id",)).collect()
    lib = tokencount.counter(P.path("byte_bpe_50k.json"), tokencount.prove(P.path("byte_bpe_50k.json"))).tokenizer
    want = {0: len(lib.encode("word " * 50_000, add_special_tokens=False).ids), 1: len(lib.encode("z" * 60_000, add_special_tokens=False).ids), 2: 1}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted([*want.items()] * 2)

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shoalspark.llm import fim

from .helpers import ODD, docs

TEXTS = [*ODD, "one two, three!", "has <P> inside", "<S", "ends in <", "ÅbcÅ xyz", "\U0001f600ab\U0001f600", "x y z " * 50_000, "w" * 200_000]


def brute(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_as_brute_force_and_back(spark):
    df = docs(spark, TEXTS * 4)
    made = fim.transform(df.drop("n_words"), keep=("doc_id", "text", "start"))
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == 4 * len(TEXTS) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"]), r["doc_id"]
        assert r["back"] == (r["text"] or "") and r["start"] == 8


def test_null_ids_repeated_rows_and_clashing_names(spark):
    df = docs(spark, ["a b c d e f"] * 3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("form", F.lit("mine"))
    got = fim.transform(df, keep=("doc_id", "form", "score")).collect()
    assert len({(r["form"], r["output"]) for r in got}) == 1 and len(got) == 3 and got[0]["score"] == 0.5
    assert (got[0]["n"], *got[0][2:][1:]) and tuple(got[0][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) == brute(None, "a b c d e f")


def test_empty_table(spark):
    assert fim.transform(docs(spark, [])).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.transform(docs(spark, [])).count() == 0


def test_bytes_that_are_no_utf8_pass_through(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF6220C328E2826320') as string)").alias("text"))
    made = fim.transform(df).select("form", F.hex(fim.restored(F.col("output"), F.col("form")).cast("binary")).alias("x"))
    assert {r["x"] for r in made.where("form = 'plain'").collect()} == {"61FF6220C328E2826320"}


def test_other_sentinels_and_shares(spark):
    df = docs(spark, ["alpha beta gamma <P>"] * 60)
    got = fim.transform(df, sentinels=("[a]", "[b]", "[c]"), plain_percent=0, spm_percent=100, seed="x").collect()
    assert {r["form"] for r in got} == {"spm"} and all(r["output"].startswith("[b]") for r in got)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)

import zlib

import numpy as np
from pyspark.sql import functions as F

from shoalspark.llm import sharding

from .helpers import ODD, docs


def checked(df, shards, **more):
    """Rows of assign(), after what holds for all tables."""
    got = sharding.assign(df, shards, keep=("doc_id", "text"), **more).collect()
    assert len(got) == df.count()
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    return got


def sums(got, shards, of=lambda r: r["size"]):
    out = np.zeros(shards)
    for r in got:
        out[r["shard"]] += of(r)
    return out


def test_equal_texts_share_a_shard_and_bytes_are_near_equal(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 99, n)) for n in rng.zipf(1.6, 3000).clip(1, 300)] + [*(t for t in ODD if len(t or "") < 99), "copy of a text"] * 9
    got = checked(docs(spark, texts), 8, bucket=400)
    places = {}
    for r in got:
        places.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values())
    by = sums(got, 8)
    assert by.max() - by.min() <= 0.01 * by.mean()
    assert sums(got, 8, lambda r: len((r["text"] or "").split())).max() < 1.1 * sum(len((r["text"] or "").split()) for r in got) / 8
    again = {(r["doc_id"], r["shard"]) for r in checked(docs(spark, texts).repartition(5), 8, bucket=400)}
    assert again == {(r["doc_id"], r["shard"]) for r in got}


def test_a_third_of_all_rows_is_one_text(spark):
    texts = ["a hot text of some length"] * 1000 + [f"another text {k} of that length" for k in range(2000)]
    got = checked(docs(spark, texts).withColumn("doc_id", F.lit(None).cast("long")), 10)
    by, rows = sums(got, 10), sums(got, 10, lambda r: 1)
    assert by.max() - by.min() <= 0.03 * by.mean() and rows.max() - rows.min() <= 0.15 * rows.mean()  # the hot text is shorter
    assert len({r["shard"] for r in got if r["text"] == texts[0]}) <= 6  # no more parts than it takes


def test_nulls_only_one_row_and_no_rows(spark):
    assert sums(checked(docs(spark, [None] * 40), 4), 4).max() <= 15 * 16
    assert len(checked(docs(spark, ["one"]), 4)) == 1
    assert checked(docs(spark, []), 4) == []


def test_a_text_that_outweighs_a_shard_stands_alone(spark):
    got = checked(docs(spark, ["x" * 100_000] + [f"y{k}" for k in range(90)]), 4)
    big = next(r["shard"] for r in got if len(r["text"]) > 1000)
    assert sum(r["shard"] == big for r in got) == 1


def test_pack_prefers_the_room_that_fits(spark):
    room = np.array([[1.0, 0.2, 1.0], [1.0, 1.0, 0.2]])
    assert sharding.pack(np.array([[0.3, 0.3, 0.01]]), room).tolist() == [1] and np.allclose(room[1], [0.7, 0.7, 0.19])


def test_written_shards_hold_their_rows_in_order(spark, tmp_path):
    got = sharding.assign(docs(spark, [f"text {k % 30}" for k in range(100)]), 3, keep=("doc_id", "text"))
    sharding.write(got, str(tmp_path / "out"), slots_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot", "text").collect())) == sorted(map(tuple, got.select("doc_id", "shard", "slot", "text").collect()))
    assert all(r["n"] <= 20 for r in back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())

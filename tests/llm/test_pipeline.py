"""The pipeline against brute force on a small table."""

import hashlib
import random

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from shoalspark.llm import bpe

from . import test_contamination, test_neardup
from .test_language import VOCAB

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, texts, langs, items):
    rows = [(i, t, lang, f"src{i % 7}", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def case():
    rng = random.Random(7)
    texts, langs = [], []
    for lang, words in VOCAB.items():
        for k in range(12):
            texts.append(" ".join(rng.choice(words) + rng.choice("abcxyz") for _ in range(40)))
            langs.append(lang)
    texts += [None, "", "1234 --- 99", texts[0], texts[13] + " tail", texts[20].upper()]
    langs += ["en", None, "en", "en", None, "de"]
    item = " ".join(rng.choice(VOCAB["en"]) + "q" for _ in range(25))
    texts += [texts[1] + " " + item, "token=abcdef99 " + texts[2], "password: zz" + " only", "é" + texts[5] + " AKIA" + "A1" * 10]
    langs += ["en"] * 4
    return texts, langs, [(0, item), (1, "short one"), (2, None)]


def test_run_as_brute_force(spark, tmp_path):
    texts, langs, items = case()
    write(spark, tmp_path, texts, langs, items)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids = list(kept)
    dup = test_neardup.brute([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if dup[k][2]}
    hit = test_contamination.brute(list(kept.values()), [(str(i), t) for i, t in items])
    kept = {i: t for k, (i, t) in enumerate(kept.items()) if not hit[k][4]}
    masked = {i: t.replace("token=abcdef99", "[SECRET]").replace("AKIA" + "A1" * 10, "[SECRET]") for i, t in kept.items()}
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    want = {}
    for i, t in masked.items():
        x = enc.encode_ordinary(t)
        want[i] = (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and len(want) > 20


def test_stages_keep_the_columns_and_others(spark, tmp_path):
    texts, langs, items = case()
    write(spark, tmp_path, texts, langs, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_between_80_and_85_percent_go(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]
    copy = [*words[:50], "other", *words[51:100], "last", *words[101:]]  # 91 of 109 shingles: 0.835
    write(spark, tmp_path, [" ".join(words), " ".join(copy), "one more text"], ["en"] * 3, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 2}


def test_one_owners_key_in_many_documents_is_masked(spark, tmp_path):
    rows = [(i, f"token=mine4567 {i}", "en", "src0", 20) for i in range(130)] + [(200 + i, "token=copied123", "en", f"src{i}", 15) for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert all(out[i] == f"[SECRET] {i}" for i in range(130)) and all(out[200 + i] == "token=copied123" for i in range(3))


def test_no_text_is_lost_under_repeated_ids(spark, tmp_path):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(3, a), (5, b), (5, a), (6, c), (6, c), (6, c + " end"), (7, None), (7, None), (None, a)]
    table = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, table, str(tmp_path)).collect()]
    assert sorted(out[k] for k in range(len(out)) if out[k][0] in (3, 5)) == [(3, a), (5, b)]
    assert len([x for x in out if x[0] == 6]) == 1 and len([x for x in out if x[0] == 7]) == 2 and (None, a) in out

import random

from pyspark.sql import functions as F

from shoalspark.llm import language

from .helpers import ODD, docs

VOCAB = {"en": "the of and to in that is was for on with as his they".split(), "de": "der die und das ist nicht ein mit für auf sich über".split(), "fr": "le la les des et est une dans pour que qui été".split()}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    texts, langs = [], []
    for lang, words in VOCAB.items():
        for _ in range(n):
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(4, 60))))
            langs.append(lang)
    return texts, langs


def test_held_out_accuracy(spark):
    texts, langs = corpus()
    df = docs(spark, texts, langs)
    odd = lambda c: F.pmod(F.crc32(c), F.lit(3)) == 1
    model = language.train(df, where=lambda i: ~odd(i), per_class=30, landmarks=30)
    got = language.identify(df.select("doc_id", odd(F.col("doc_id").cast("string")).alias("held_out"), "text"), model).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_undetermined_texts(spark):
    texts, langs = corpus(10)
    model = language.train(docs(spark, texts, langs))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs(spark, ODD).select("doc_id", "text"), model).collect()}
    for i, t in enumerate(ODD):
        assert (got[i] == "und") == (not any(c.isalpha() for c in t or "")), (i, t)


def test_text_is_the_only_input(spark):
    texts, langs = corpus(10)
    model = language.train(docs(spark, texts, langs))
    a = language.identify(docs(spark, texts, langs).select("doc_id", "text"), model)
    b = language.identify(docs(spark, texts, ["zz"] * len(texts)).select("doc_id", "text"), model)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nothing_learned_and_empty(spark):
    model = language.train(docs(spark, []))
    assert [r["lang_pred"] for r in language.identify(docs(spark, ["the"]).select("text"), model).collect()] == ["und"]
    assert language.identify(docs(spark, []).select("text"), model).count() == 0


def test_distinct_grams():
    rng = random.Random(2)
    for n in (1, 3, 300, 5000):
        t = "".join(rng.choice("abc é\n") for _ in range(n)).encode()
        folded = b" ".join(t.replace(b"\n", b" ").split(b" "))
        import re

        folded = re.sub(b" +", b" ", folded)
        for k, got in enumerate(language.gram_codes(t), 1):
            want = {int.from_bytes(folded[i : i + k], "big") for i in range(len(folded) - k + 1)}
            assert set(got.tolist()) == want and len(got) == len(want)


def test_long_texts_are_learned_and_names_may_clash(spark):
    texts, langs = ["zzyx qqaw " * 40_000, "the cat of it " * 3, "the cat of it " * 3, None], ["xx", "en", "en", "fr"]
    df = docs(spark, texts, langs).withColumn("lang_pred", F.lit(1))
    model = language.train(df, fit_chars=1000)
    assert model["classes"] == ["en", "xx"] and len(model["marks"]) == 2  # equal texts are learned once
    got = language.identify(df, model)
    assert [c for c in got.columns if c in ("lang_pred", "score")] == ["lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {0: "xx", 1: "en", 2: "en", 3: "und"}


def test_repeated_rows_are_predicted_each(spark):
    texts, langs = corpus(10)
    df = docs(spark, texts, langs)
    model = language.train(df.unionByName(df))
    assert len(model["marks"]) == len(language.train(df)["marks"])
    got = language.identify(df.unionByName(df).select("doc_id", "text"), model).collect()
    assert len(got) == 2 * len(texts) and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in got}) == len(texts)

"""The thin queries over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, bpe, contamination, fim, html, language, lattice, neardup, ngramlm, secrets, sharding, suffix, tokencount
from .common import pick, table
from .oracles import SQL


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), keep=("doc_id",))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    return ngramlm.score(table(spark, sf_dir, "documents"), held_out)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), keep=("doc_id",))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = lambda i: F.pmod(F.crc32(F.coalesce(i, F.lit(""))), F.lit(3))
    model = language.train(pick(docs, "doc_id", "text", "lang"), where=lambda i: bucket(i) != 1)
    rows = docs.select("doc_id", (bucket(F.col("doc_id").cast("string")) == 1).alias("held_out"), "text")
    return language.identify(rows, model).drop("text")


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words", "items")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    number = lambda c: F.crc32(F.col(c).cast("string").cast("binary"))
    used = lambda df, c, key: asof.floored(asof.micros(df, c), number(key) % 2 == 1, 24 * asof.HOUR)
    probes = clicks.select("click_id", "client_id", used(clicks, "ts", "click_id").alias("ts_us"))
    cents = F.floor(F.lit(100.0) * F.col("total") + 0.5).cast("long")
    first = sales.select("client_id", used(sales, "sold_at", "sale_id").alias("at_us"), "sale_id", F.col("priority").cast("long").alias("priority"), cents.alias("total_cents"), (number("sale_id") % 3 != 0).alias("twice"))
    both = F.array(F.struct("sale_id", "priority"), F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority")))
    orders = first.select("client_id", "at_us", "total_cents", F.inline(F.when(F.col("twice"), both).otherwise(F.slice(both, 1, 1))))
    out = asof.join(probes, orders, key="client_id", probe_id="click_id", probe_time="ts_us", time="at_us", rank=(("priority", True), ("sale_id", False)), values=("total_cents",), tolerance=72 * asof.HOUR)
    return out.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("at_us")).alias("lag_us"), "total_cents", "n_tied")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The corpus pipeline: five stages over documents, each calling one operator.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of documents. Extra columns of any name pass
through untouched. Stages write nothing themselves: the caller stores each
result as Parquet and reads it again, as run() does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.llm import bpe, contamination, language, neardup, secrets
from shoalspark.llm.common import forget, materialize, reachable, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language takes, go; all others stay.

    If no document is labelled nothing can be learned and nothing is rejected.
    """
    reachable(spark)
    model = language.train(docs)
    if not model["classes"]:
        return docs
    packed = docs.select("text", F.struct("*").alias("__doc"))
    return language.identify(packed, model).where("lang_pred <> 'und'").select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.80 or more) stays, the one of least id.

    A document is a row, told by its id and its text: of several texts under a
    group's least id the one of least hash stays, and of equal rows one. Rows
    without words or id are linked with nothing and all stay.
    """
    reachable(spark)
    found = neardup.near_duplicates(docs, percent=80, text_hash=True).where("n_shingles > 0 and doc_id is not null")
    found = found.groupBy("doc_id", "th").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    firsts = found.where("kept").groupBy("doc_id").agg(F.min("th").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    found = materialize(found.join(firsts, "doc_id", "left").select("doc_id", "th", (F.col("kept") & F.coalesce(F.col("th") == F.col("first"), F.lit(True))).alias("kept"), "n"), "near-duplicates")
    packed = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"))
    key = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    left = packed.join(key(found.where("not kept")), ["__id", "__th"], "left_anti")
    again = key(found.where("kept and n > 1"))
    if not again.isEmpty():
        left = left.join(again, ["__id", "__th"], "left_anti").unionByName(left.join(again, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]))
    return left.select("__doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("__doc"))
    return contamination.decontaminate(packed, table(spark, sf_dir, "benchmark"), keep=("__doc",)).where("not contaminated").select("__doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of one or two owners are masked in the text, however many documents hold them, and n_chars follows; all documents stay."""
    out = secrets.redact(docs, max_repos=None)  # a document is no repository
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of their decoding."""
    import public_tokenizers

    reachable(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]
#: The kernels, forests and merges of the stages are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read again; a stage's input goes once its result stands."""
    docs = table(spark, sf_dir, "documents")
    top = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            forget(spark, f"{top}/{k - 1}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

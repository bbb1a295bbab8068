"""A corpus through toxicity, near-duplicates, benchmark leaks, personal data and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further columns there are. In every stage null
and empty texts are texts without words, very long ones are taken whole, repeated rows and ties are rows like any others
unless a stage says otherwise, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import bpe, decontaminate, near_dedup, pii, toxicity
from glyphlake.llm.common import drop_saved, save


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity model, fitted on the labelled rows of these documents, scores at its threshold or above. Without
    labels of both classes every row gets the share of toxic labels as its score. Rows without an id are scored too."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least id; of several rows under it the one with the
    least text. Rows without an id, and texts without words, are nobody's duplicate and stay."""
    return near_dedup.keep_one(docs, near_dedup.find_duplicates(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows of one id, and rows without an id, go or stay together."""
    return decontaminate.keep_clean(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all texts by its kind; n_chars follows the new text. A null text becomes an empty one."""
    kind = docs.schema["n_chars"].dataType
    return pii.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast(kind))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left; an empty text has no tokens."""
    return bpe.digests(bpe.encode_documents(docs, decode=True))


STAGES = [("toxicity", clean_speech), ("near_dedup", one_of_each), ("decontamination", without_leaks), ("pii", without_names), ("byte_bpe", tokens)]

#: A boosted model and random register bands are beyond SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over everything its predecessor kept."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_saved(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

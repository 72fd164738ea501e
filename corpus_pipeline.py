"""Corpus preparation: five operators of ``reviewlens.llm`` as consecutive stages over documents.

Every stage takes what the one before kept and decides on its own input:

1. ``toxicity`` drops documents that the classifier chain, fitted on the labelled ones, rejects.
2. ``near_dedup`` keeps one document of each group of near copies (five-word shingles, similarity 0.8).
3. ``substring_dedup`` takes passages of 35 words or more that occur elsewhere out of the texts; documents
   that have no word left go.
4. ``secrets`` masks the spans of secrets.
5. ``packing`` deals the texts to training sequences: one row per piece of a document, with the text of the piece.

All stages but the last return the columns of documents, with n_chars of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import minhash, packing, repeats, secrets, toxicity
from reviewlens.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit_chain(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(docs, others=True).where("n_removed = 0 OR n_removed < n_words")
    return with_text(docs, found.select("others.*", F.col("kept").alias("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(docs, secrets.mask_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_words(docs).withColumnRenamed("content", "text")


def with_text(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of before, in their order, with n_chars counted anew where there is such a column."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*(F.col(f"`{c}`") for c in before.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

# SQL can't express the fitted chain and the packing; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read back before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

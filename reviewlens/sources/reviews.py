"""Review tables: parquet with labels, and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from reviewlens import schemas
from reviewlens.functions.decision import label_to_int


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.REVIEWS).parquet(f"{folder}/documents.parquet")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).parquet(f"{folder}/labels.parquet")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(f"{folder}/pages.parquet")


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.CONVERSATIONS).parquet(f"{folder}/conversations.parquet")


def labelled_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, source, label, toxic). Both sides grow, so the join carries no hint."""
    labels = read_labels(spark, folder).withColumnRenamed("quality", "label")
    return (
        read_documents(spark, folder)
        .select("doc_id", "text", "source")
        .join(labels, "doc_id")
    )


def in_test_part(source: Column) -> Column:
    """The data's own train/test division: sources numbered 10 and up are the test part.

    A source that is null or has no number at its end belongs to the rest.
    """
    return F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("decimal(38,0)") >= 10, F.lit(False))


def read_review_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Reviews from the first path that exists; quotes are doubled, newlines may be quoted.

    A quoted newline hides row ends from a reader that starts in mid-file, so one file is
    one task: large inputs should come as many files.
    """
    for path in paths:
        try:
            return spark.read.csv(
                path, schema=schemas.REVIEW_CSV, header=True, multiLine=True, quote='"', escape='"',
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", lineSep="\n",
            )
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    raise FileNotFoundError(f"no review CSV at any of {list(paths)}")


def write_review_csv(reviews: DataFrame, path: str) -> None:
    reviews.select("review", "sentiment").write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def with_int_label(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("label", label_to_int(F.col("sentiment")))

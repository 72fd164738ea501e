"""Queries on cleaning, projections and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.functions import text as X
from reviewlens.functions.decision import int_to_label, label_to_int, predicted_int
from reviewlens.functions.tokens import word_tokens
from reviewlens.operators import splits
from reviewlens.plans import oracle as O
from reviewlens.session import scratch_path
from reviewlens.sources import reviews as R

CONFIG = JobConfig()


def clean_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = X.clean_steps(F.col("html"))
    return R.read_pages(spark, sf).select("page_id", *[c.alias(n) for n, c in steps.items()])


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_pages(spark, sf).select("page_id", X.clean(F.col("html")).alias("cleaned"))


def clean_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_conversations(spark, sf).select("conv_id", "turn", X.clean(F.col("text")).alias("cleaned"))


def legacy_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_documents(spark, sf).select("doc_id", X.legacy_normalise(F.col("text")).alias("normalised"))


def truncate_count(spark: SparkSession, sf: str) -> DataFrame:
    limit = CONFIG.text_max_chars
    return R.read_documents(spark, sf).select(
        "doc_id",
        X.truncate(F.col("text"), limit).alias("shown"),
        F.length("text").cast("long").alias("n_chars"),
        F.least(F.length("text"), F.lit(limit)).cast("long").alias("n_shown"),
    )


def clean_audit(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = R.read_pages(spark, sf).select(X.clean(F.col("html")).alias("c"))
    return cleaned.agg(
        F.count("*").alias("n_pages"), F.count_if(X.has_residual_markup(F.col("c"))).alias("n_residual")
    )


def clean_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = R.read_pages(spark, sf).select(X.clean(F.col("html")).alias("c"))
    return cleaned.agg(
        F.count("*").alias("n_pages"), F.count_if(X.clean(F.col("c")) != F.col("c")).alias("n_changed")
    )


def accent_strip(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_documents(spark, sf).select("doc_id", X.without_accents(F.col("text")).alias("plain"))


def labelled_reviews(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf)
    return (
        docs.withColumn("split", F.when(R.in_test_part(F.col("source")), F.lit("test")).otherwise(F.lit("train")))
        .withColumn("n_tokens", F.size(word_tokens(X.clean(F.col("text")))).cast("long"))
        .drop("text", "source", "toxic")
        .withColumnRenamed("label", "labels")
    )


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    # Toxic reviews get a differently cased label, which maps to nothing.
    sentiment = F.when(F.col("toxic") == 1, F.lit("Positive")).otherwise(int_to_label(F.col("label")))
    return R.labelled_reviews(spark, sf).select("doc_id", sentiment.alias("sentiment")).select(
        "doc_id", "sentiment",
        label_to_int(F.col("sentiment")).alias("label"),
        predicted_int(F.col("sentiment")).alias("pred"),
    )


def shape_preview(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.read_documents(spark, sf)
    n_rows, n_columns = docs.count(), len(docs.columns)
    last = docs.orderBy(F.col("doc_id").desc()).limit(5).select("doc_id", "text")
    return last.withColumn("n_rows", F.lit(n_rows).cast("long")).withColumn("n_columns", F.lit(n_columns))


def non_blank(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_documents(spark, sf).filter(X.is_not_blank(F.col("text"))).select(
        "doc_id", X.strip_whitespace(F.col("text")).alias("stripped")
    )


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reviews-csv")
    R.write_review_csv(
        R.labelled_reviews(spark, sf).select(F.col("text").alias("review"), int_to_label(F.col("label")).alias("sentiment")),
        path,
    )
    back = R.with_int_label(R.read_review_csv(spark, path + "-missing", path))
    return back.select("review", "sentiment", "label")


def _train_val(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_val_split(R.labelled_reviews(spark, sf), "doc_id", "label", CONFIG.val_ratio, CONFIG.seed)


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return _train_val(spark, sf).select("doc_id", "label", "split")


def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf)
    return splits.three_way_split(
        docs, "doc_id", "label", CONFIG.holdout_ratio, CONFIG.holdout_val_share, CONFIG.seed
    ).select("doc_id", "label", "split")


def three_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled reviews with the data's own test part and a validation part."""
    docs = R.labelled_reviews(spark, sf)
    return splits.predefined_split(
        docs, R.in_test_part(F.col("source")), "doc_id", "label", CONFIG.val_ratio, CONFIG.seed
    )


def split_predefined(spark: SparkSession, sf: str) -> DataFrame:
    return three_parts(spark, sf).select("doc_id", "label", "split")


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_summary(three_parts(spark, sf), "label")


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf).select(int_to_label(F.col("label")).alias("sentiment"))
    before = splits.class_counts(docs, F.col("sentiment")).withColumn("stage", F.lit("before"))
    after = splits.class_counts(docs, label_to_int(F.col("sentiment")).cast("string")).withColumn("stage", F.lit("after"))
    return before.unionByName(after).select("stage", "class", "n")


def pairing_check(spark: SparkSession, sf: str) -> DataFrame:
    return splits.pairing_check(R.labelled_reviews(spark, sf), "text", "label")


QUERIES = {
    f.__name__: f
    for f in (
        clean_steps, clean_pages, clean_conversations, legacy_normalise, truncate_count, clean_audit,
        clean_idempotent, accent_strip, labelled_reviews, label_map, shape_preview, non_blank, csv_roundtrip,
        split_stratified, split_three_way, split_predefined, split_summary, class_counts, pairing_check,
    )
}

_WS = O.WHITESPACE

ORACLES = {
    "clean_steps": O.with_ctes(
        [
            f"a AS (SELECT page_id, {O.tags('html')} AS no_tags FROM pages)",
            f"b AS (SELECT *, {O.entities('no_tags')} AS no_entities FROM a)",
            f"c AS (SELECT *, {O.addresses('no_entities')} AS no_urls FROM b)",
            "d AS (SELECT *, lower(no_urls) AS lowered FROM c)",
            f"e AS (SELECT *, regexp_replace(lowered, '[^a-z0-9{_WS}]', ' ', 'g') AS no_symbols FROM d)",
            f"f AS (SELECT *, regexp_replace(no_symbols, '[{_WS}]+', ' ', 'g') AS collapsed FROM e)",
        ],
        "SELECT *, trim(collapsed) AS cleaned FROM f",
    ),
    "clean_pages": f"SELECT page_id, {O.clean('html')} AS cleaned FROM pages",
    "clean_conversations": f"SELECT conv_id, turn, {O.clean('text')} AS cleaned FROM conversations",
    "legacy_normalise": f"SELECT doc_id, regexp_replace(lower(text), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS normalised FROM documents",
    "truncate_count": """SELECT doc_id, substring(text, 1, 5000) AS shown, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(least(length(text), 5000) AS BIGINT) AS n_shown FROM documents""",
    "clean_audit": f"""SELECT count(*) AS n_pages,
  count(*) FILTER (contains(c, '<br') OR contains(c, '</') OR contains(c, '&amp;')) AS n_residual
FROM (SELECT {O.clean('html')} AS c FROM pages)""",
    "clean_idempotent": f"""SELECT count(*) AS n_pages, count(*) FILTER ({O.clean('c')} <> c) AS n_changed
FROM (SELECT {O.clean('html')} AS c FROM pages)""",
    "accent_strip": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "labelled_reviews": O.with_ctes(
        [O.DOCS],
        f"""SELECT doc_id, label AS labels,
  CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) >= 10 THEN 'test' ELSE 'train' END AS split,
  CAST(len({O.words(O.clean('text'))}) AS BIGINT) AS n_tokens FROM docs""",
    ),
    "label_map": O.with_ctes(
        [
            O.DOCS,
            """s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Positive' WHEN label = 1 THEN 'positive'
  WHEN label = 0 THEN 'negative' END AS sentiment FROM docs)""",
        ],
        """SELECT doc_id, sentiment,
  CAST(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS INTEGER) AS label,
  CAST(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END AS INTEGER) AS pred FROM s""",
    ),
    "shape_preview": """SELECT doc_id, text, (SELECT count(*) FROM documents) AS n_rows,
  CAST((SELECT count(*) FROM (DESCRIBE documents)) AS INTEGER) AS n_columns
FROM documents ORDER BY doc_id DESC LIMIT 5""",
    "non_blank": f"""SELECT doc_id, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS stripped
FROM documents WHERE regexp_matches(text, '[^{_WS}]')""",
    "csv_roundtrip": O.with_ctes(
        [O.DOCS],
        """SELECT text AS review, CASE label WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS sentiment, label FROM docs""",
    ),
    "split_stratified": O.with_ctes([O.DOCS, O.train_val("s", "docs")], "SELECT doc_id, label, split FROM s"),
    "split_three_way": O.with_ctes(
        [
            O.DOCS,
            """r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || doc_id), doc_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM docs)""",
        ],
        """SELECT doc_id, label, CASE WHEN rn <= n * 8 // 10 THEN 'train' WHEN rn <= n * 9 // 10 THEN 'val'
  ELSE 'test' END AS split FROM r""",
    ),
    "split_predefined": O.with_ctes([O.DOCS, *O.three_parts("s", "docs")], "SELECT doc_id, label, split FROM s"),
    "split_summary": O.with_ctes(
        [O.DOCS, *O.three_parts("s", "docs")],
        """SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
FROM s GROUP BY split""",
    ),
    "class_counts": O.with_ctes(
        [O.DOCS],
        """SELECT 'before' AS stage, CASE label WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS class, count(*) AS n
FROM docs GROUP BY label
UNION ALL SELECT 'after', CAST(label AS VARCHAR), count(*) FROM docs GROUP BY label""",
    ),
    "pairing_check": O.with_ctes(
        [
            O.DOCS,
            """a AS (SELECT count(text) AS n_texts, count(label) AS n_labels,
  count(*) FILTER (text IS NULL OR label IS NULL) AS n_unpaired,
  count(*) FILTER (label NOT IN (0, 1)) AS n_bad_labels FROM docs)""",
        ],
        "SELECT *, n_unpaired = 0 AND n_bad_labels = 0 AS paired FROM a",
    ),
}

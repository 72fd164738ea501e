"""TF-IDF as a relational job, and linear scores computed from it."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.decision import sigmoid
from reviewlens.functions.tokens import CLEANED, WordPath
from reviewlens.operators.rows import ROW
from reviewlens.operators.vocabulary import Vocabulary, fit_vocabularies, term_counts, term_rows
from reviewlens.session import byte_size, fits_broadcast, join_by_size, materialise, scratch_path


def raw_weight(tf: Column, idf: Column) -> Column:
    """Sublinear term frequency times idf, before normalisation."""
    return (F.lit(1.0) + F.log(tf.cast("double"))) * idf


def known_counts(
    docs: DataFrame, keys: list[str], text: str, ngram_range: tuple[int, int], path: WordPath, terms: DataFrame, size_bytes: int,
    carry: list[str] = [],
) -> DataFrame:
    """(keys, carry, ROW, empty, term_id, tf, other columns of terms) of the terms that ``terms`` (term, term_id,
    numbers) knows; a document without known terms has one row with a null term_id, others may have one.

    Terms that can be broadcast are matched before they are counted: numbers are counted faster than strings, and
    unknown terms not at all. Others are counted first, so that fewer rows are shuffled to meet them.
    """
    numbers = [c for c in terms.columns if c not in ("term", "term_id")]
    if not fits_broadcast(size_bytes):
        rows, tf = term_counts(docs, keys, text, ngram_range, carry, path), F.sum("tf")
        found = join_by_size(rows, terms, ["term"], "left", size_bytes, ROW)
    else:
        rows, tf = term_rows(docs, keys, text, ngram_range, carry, path), F.count("*")
        found = join_by_size(rows, terms, ["term"], "left", size_bytes, ROW)
        found = found.filter(F.col("term_id").isNotNull() | F.col("term").isNull())
    # The numbers are the same wherever the term is.
    return found.groupBy(*keys, *carry, *ROW, "empty", "term_id").agg(tf.alias("tf"), *[F.max(c).alias(c) for c in numbers])


def known_terms(docs: DataFrame, keys: list[str], text: str, vocab: Vocabulary, carry: list[str] = []) -> DataFrame:
    """Counts of known terms with their idf; ROW tells documents apart."""
    terms = vocab.table.select("term", "term_id", "idf")
    return known_counts(docs, keys, text, vocab.ngram_range, vocab.path, terms, vocab.size_bytes, carry)


def tfidf_weights(docs: DataFrame, keys: list[str], text: str, vocab: Vocabulary, carry: list[str] = []) -> DataFrame:
    """(keys, carry, term, term_id, weight), each document of length 1.

    Unknown terms are dropped, but a document without any known term keeps one row with
    null term and weight: its vector is all zero, not absent. Rows that repeat a key have a
    vector each.
    """
    weighted = known_terms(docs, keys, text, vocab, carry).select(
        *keys, *carry, *ROW, "term_id", raw_weight(F.col("tf"), F.col("idf")).alias("raw")
    )
    # The window is the known terms of one text.
    own = Window.partitionBy(*ROW)
    weights = weighted.select(
        *keys, *carry, *ROW, "term_id", "raw",
        F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(own)).alias("norm"),
    ).filter(F.col("raw").isNotNull() | F.col("norm").isNull()).select(
        *keys, *carry, *ROW, "term_id", (F.col("raw") / F.col("norm")).alias("weight"))
    names = vocab.table.select("term_id", "term")
    return join_by_size(weights, names, ["term_id"], "left", vocab.size_bytes, ROW).select(
        *keys, *carry, "term", "term_id", "weight")


def sparse_vectors(docs: DataFrame, keys: list[str], text: str, vocab: Vocabulary, carry: list[str] = []) -> DataFrame:
    """Feature vectors in the stored form of an ML vector: type, size, indices, values; one per row of docs."""
    weighted = known_terms(docs, keys, text, vocab, carry).select(
        *keys, *carry, *ROW, "term_id", raw_weight(F.col("tf"), F.col("idf")).alias("raw")
    )
    grouped = weighted.groupBy(*keys, *carry, *ROW).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        # The natural order of structs; array_sort would call a comparing function for each two.
        F.sort_array(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("term_id", "raw")))).alias("terms"),
    )
    return grouped.select(
        *keys, *carry,
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(vocab.size).alias("size"),
            F.col("terms.term_id").alias("indices"),
            F.transform("terms.raw", lambda r: r / F.col("norm")).alias("values"),
        ).alias("features"),
    )


def vector_table(docs: DataFrame, keys: list[str], text: str, vocab: Vocabulary, carry: list[str] = []) -> DataFrame:
    """Write the vectors to the shared folder and read them back as ML vectors.

    Parquet keeps an ML vector as exactly the struct above, so no Python touches a row, and
    an iterative fit reads a table instead of redoing the text work.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    spark = docs.sparkSession
    path = scratch_path(spark, "vectors")
    built = sparse_vectors(docs, keys, text, vocab, carry)
    built.write.parquet(path)
    schema = T.StructType([
        *[built.schema[c] for c in [*keys, *carry]],
        T.StructField("features", VectorUDT()),
    ])
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class LinearModel:
    """A vocabulary whose table also has ``coef``, and an intercept."""

    key: str
    vocab: Vocabulary | None
    intercept: float


def class_log_odds_models(
    docs: DataFrame,
    keys: list[str],
    text: str,
    label: str,
    limits: dict[str, tuple[int, tuple[int, int]]],
) -> list[LinearModel]:
    """Models whose coefficients come straight from class document frequencies.

    ``limits`` gives (max_features, ngram_range) per model key; one pass fits them all.
    """
    fitted = fit_vocabularies(docs, keys, text, list(limits.values()), label)
    models = []
    for key, vocab in zip(limits, fitted):
        n_pos, n_neg = vocab.n_pos, vocab.n_docs - vocab.n_pos
        coef = (
            F.log((F.col("df_pos") + F.lit(1.0)) / F.lit(n_pos + 2.0))
            - F.log((F.col("df") - F.col("df_pos") + F.lit(1.0)) / F.lit(n_neg + 2.0))
        )
        table = vocab.table.withColumn("coef", coef)
        models.append(LinearModel(key, replace(vocab, table=table, size_bytes=vocab.size_bytes + 8 * vocab.size), 0.0))
    return models


def class_log_odds_model(
    docs: DataFrame,
    keys: list[str],
    text: str,
    label: str,
    max_features: int,
    ngram_range: tuple[int, int],
    key: str = "log_odds",
) -> LinearModel:
    return class_log_odds_models(docs, keys, text, label, {key: (max_features, ngram_range)})[0]


def class_prior_model(n_docs: int, n_pos: int, key: str = "class_prior") -> LinearModel:
    """Scores every text with the smoothed share of positive documents."""
    return LinearModel(key, None, math.log((n_pos + 1) / (n_docs - n_pos + 1)))


def score_models(
    docs: DataFrame, keys: list[str], text: str, models: list[LinearModel], carry: list[str] = []
) -> DataFrame:
    """``p_<model>`` of every model for each row, from one pass over the texts.

    There are as many rows as in ``docs``, also where rows share a key or have none. All models' vocabularies are laid side by side in one term table, so the documents are
    exploded, counted and grouped once however many models there are. Empty text scores 0.5.
    """
    with_terms = [m for m in models if m.vocab is not None]
    low = min((m.vocab.ngram_range[0] for m in with_terms), default=1)
    high = max((m.vocab.ngram_range[1] for m in with_terms), default=1)
    paths = {m.vocab.path for m in with_terms} or {CLEANED}
    if len(paths) > 1:
        raise ValueError("models that cut words in different ways need a pass each")
    path = paths.pop()
    if with_terms:
        side = None
        for m in with_terms:
            own = m.vocab.table.select(
                "term", "term_id", F.col("idf").alias(f"idf_{m.key}"), F.col("coef").alias(f"coef_{m.key}"))
            side = own if side is None else side.drop("term_id").join(own.drop("term_id"), "term", "full")
        if len(with_terms) > 1:
            side = materialise(side.withColumn("term_id", F.monotonically_increasing_id()))
            size = byte_size(side)
        else:
            size = with_terms[0].vocab.size_bytes
        counts = known_counts(docs, keys, text, (low, high), path, side, size, carry)
    else:
        counts = term_counts(docs, keys, text, (low, high), carry, path)
    sums = []
    for m in with_terms:
        w = raw_weight(F.col("tf"), F.col(f"idf_{m.key}"))
        sums.append(F.sum(w * F.col(f"coef_{m.key}")).alias(f"dot_{m.key}"))
        sums.append(F.sum(w * w).alias(f"sq_{m.key}"))
    # No sums at all when every model is constant; the count keeps the aggregate valid.
    grouped = counts.groupBy(*keys, *carry, *ROW, "empty").agg(*(sums or [F.count("tf").alias("n_terms")]))

    def probability(m: LinearModel) -> Column:
        z = F.lit(float(m.intercept))
        if m.vocab is not None:
            z = z + F.coalesce(F.col(f"dot_{m.key}") / F.sqrt(F.col(f"sq_{m.key}")), F.lit(0.0))
        return F.when(F.col("empty"), F.lit(0.5)).otherwise(sigmoid(z)).alias(f"p_{m.key}")

    return grouped.select(*keys, *carry, "empty", *[probability(m) for m in models])


def score(docs: DataFrame, keys: list[str], text: str, model: LinearModel, carry: list[str] = []) -> DataFrame:
    """(keys, carry, empty, p_pos) of one model."""
    return score_models(docs, keys, text, [model], carry).withColumnRenamed(f"p_{model.key}", "p_pos")

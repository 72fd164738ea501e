"""Batch scoring: one result per text in input order, and a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.decision import prediction
from reviewlens.operators.tfidf import LinearModel, score
from reviewlens.operators.validate import drop_oversized, validate_batches
from reviewlens.session import materialise


def explode_requests(requests: DataFrame, batch: str, texts: str) -> DataFrame:
    """(batch, pos, text) of requests that hold an array of texts."""
    return requests.select(batch, F.posexplode_outer(texts).alias("pos", "text"))


def batch_predict(
    rows: DataFrame,
    batch: str,
    position: str,
    text: str,
    model: LinearModel,
    max_texts: int,
    max_chars: int,
    enforce_item_limit: bool = False,
) -> DataFrame:
    """(batch, status, model, count, predictions) for every batch; rejected ones have null in the last three.

    One prediction per text, by position; texts that share a position have one each. Rows without a batch make
    up a batch of their own.
    """
    statuses = materialise(validate_batches(rows, batch, text, max_texts, max_chars, enforce_item_limit))
    kept = drop_oversized(rows, batch, position, statuses)
    scored = score(kept, [batch, position], text, model)
    regrouped = (
        scored.withColumn("prediction", prediction(F.col("p_pos")))
        # At most max_texts rows per batch are left.
        .groupBy(batch)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(position), F.col("prediction")))).alias("_r"))
        .select(batch, F.col("_r.prediction").alias("predictions"))
    )
    own = regrouped.select(F.col(batch).alias("_batch"), "predictions")
    return statuses.join(own, F.col(batch).eqNullSafe(F.col("_batch")), "left").select(
        batch,
        "status",
        F.when(F.col("status") == 200, F.lit(model.key)).alias("model"),
        F.when(F.col("status") == 200, F.col("n")).alias("count"),
        F.when(F.col("status") == 200, F.col("predictions")).alias("predictions"),
    )

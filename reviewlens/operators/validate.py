"""Request limits: every row gets a status and a reason, none is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import byte_size, join_by_size


def text_reason(text: Column, low: int, high: int) -> Column:
    n = F.length(text)
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(n < low, F.lit("too_short"))
        .when(n > high, F.lit("too_long"))
        .otherwise(F.lit("ok"))
    )


def validate_texts(docs: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """Whitespace alone is long enough; it is scored as empty text later."""
    reason = text_reason(F.col(text), low, high)
    return docs.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason") == "ok", 200).otherwise(422)
    ).withColumn("valid", F.col("status") == 200)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("valid").drop("valid", "status", "reason")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("valid"))


def batch_status(n: Column, n_too_long: Column, max_texts: int, enforce_item_limit: bool) -> Column:
    bad = (n < 1) | (n > max_texts)
    if enforce_item_limit:
        bad = bad | (n_too_long > 0)
    return F.when(bad, 422).otherwise(200)


def validate_batches(
    rows: DataFrame, batch: str, text: str, max_texts: int, max_chars: int, enforce_item_limit: bool = False
) -> DataFrame:
    """One row per batch. The limit on single texts is only enforced on demand.

    Counters only: partial sums are merged before the shuffle, however big one batch is.
    A row whose text is null stands for a batch without texts.
    """
    counted = rows.groupBy(batch).agg(
        F.count(text).alias("n"),
        F.count_if(F.length(text) > max_chars).alias("n_too_long"),
    )
    return counted.withColumn(
        "status", batch_status(F.col("n"), F.col("n_too_long"), max_texts, enforce_item_limit)
    )


def validate_batch_arrays(
    requests: DataFrame, texts: str, max_texts: int, max_chars: int, enforce_item_limit: bool = False
) -> DataFrame:
    """The same for requests that hold their texts in one array column."""
    too_long = F.size(F.filter(texts, lambda t: F.length(t) > max_chars))
    n = F.when(F.col(texts).isNull(), 0).otherwise(F.size(texts))
    return requests.withColumn("status", batch_status(n, too_long, max_texts, enforce_item_limit))


def drop_oversized(rows: DataFrame, batch: str, position: str, statuses: DataFrame) -> DataFrame:
    """Rows of accepted batches only.

    Rejected batches are the small side here, and the join is size-checked and salted, so a
    batch of any size is discarded without gathering it. What is left has a known bound per
    batch and may be grouped. ``statuses`` should be a materialised table.
    """
    rejected = statuses.filter(F.col("status") != 200).select(batch)
    # Structs of one field are equal also where the field is null.
    own = rejected.select(F.struct(batch).alias("_batch"))
    kept = join_by_size(rows.withColumn("_batch", F.struct(batch)), own, ["_batch"], "left_anti", byte_size(rejected), [batch, position])
    return kept.drop("_batch")

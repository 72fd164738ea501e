"""Evaluation: every metric comes from counters that merge before they shuffle."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.decision import predicted_int, verdict
from reviewlens.session import byte_size, join_by_size, materialise

# The log loss is taken of probabilities kept this far from 0 and 1.
LOSS_EPSILON = 1e-7


def with_prediction(scored: DataFrame, p_pos: str = "p_pos") -> DataFrame:
    return scored.withColumn("pred", predicted_int(verdict(F.col(p_pos))))


def confusion_counts(scored: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    y, z = F.col(label), F.col(pred)
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(y == z).alias("correct"),
        F.count_if((z == 1) & (y == 1)).alias("tp"),
        F.count_if((z == 1) & (y == 0)).alias("fp"),
        F.count_if((z == 0) & (y == 0)).alias("tn"),
        F.count_if((z == 0) & (y == 1)).alias("fn"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def binary_metrics(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """accuracy, precision, recall and f1 from confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return counts.select(
        "*",
        shown(ratio(F.col("correct"), F.col("total"))).alias("accuracy"),
        shown(precision).alias("precision"),
        shown(recall).alias("recall"),
        shown(f1_of(precision, recall)).alias("f1"),
    )


def class_report(counts: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Rows for both classes, accuracy, macro and weighted average, from confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = f1_of(p1, r1), f1_of(p0, r0)
    n1, n0 = tp + fn, tn + fp

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.round(p, digits).alias("precision"),
            F.round(r, digits).alias("recall"),
            F.round(f, digits).alias("f1_score"),
            n.cast("long").alias("support"),
        )

    def macro(a: Column, b: Column) -> Column:
        return (a + b) / F.lit(2.0)

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * n0 + b * n1, n0 + n1)

    none = F.lit(None).cast("double")
    rows = F.array(
        row("negative", p0, r0, f0, n0),
        row("positive", p1, r1, f1, n1),
        row("accuracy", none, none, ratio(F.col("correct"), F.col("total")), F.col("total")),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), F.col("total")),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), F.col("total")),
    )
    return counts.select(*by, F.inline(rows))


def confusion_matrix(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows are the actual class, columns the predicted one; zeros stay."""
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
    )
    return counts.select(*by, F.inline(cells))


def log_loss(scored: DataFrame, by: list[str], label: str = "label", p_pos: str = "p_pos") -> DataFrame:
    """Mean binary cross-entropy and accuracy."""
    p = F.greatest(F.lit(LOSS_EPSILON), F.least(F.lit(1.0 - LOSS_EPSILON), F.col(p_pos)))
    y = F.col(label).cast("double")
    loss = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    hit = (predicted_int(verdict(F.col(p_pos))) == F.col(label)).cast("double")
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"), F.avg(loss).alias("loss"), F.avg(hit).alias("accuracy")
    )


def latency_stats(
    rows: DataFrame, by: str, latency: str, accuracy: int = 10_000, margin: float = 2e-4
) -> DataFrame:
    """Mean and 95th percentile: the sorted element at floor(0.95 n), counted from 0.

    The element is exact. An approximate percentile, whose rank error is below
    n / accuracy, brackets it first; then only distinct values inside the bracket are
    ranked, plus one counter for everything below. Those counters tell whether the bracket
    holds the rank; if one doesn't, all are widened and counted again. A group with a third of
    all rows costs one mergeable sketch and a sliver of its rows.
    """
    timed = rows.filter(F.col(latency).isNotNull()).select(F.col(by), F.col(latency).alias("_v"))
    while True:
        brackets, histogram = bracketed(timed, by, margin, accuracy)
        below, upto = F.sum(F.when(F.col("_v").isNull(), F.col("_k")).otherwise(0)), F.sum("_k")
        missed = histogram.groupBy(by).agg(F.first("_rank").alias("_rank"), below.alias("_below"), upto.alias("_upto"))
        if margin >= 1 or missed.filter("_below > _rank OR _upto <= _rank").isEmpty():
            break
        margin *= 32
    up = Window.partitionBy(by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    p95 = (
        histogram.withColumn("_upto", F.sum("_k").over(up))
        .filter(F.col("_upto") > F.col("_rank"))
        .groupBy(by).agg(F.min("_v").alias("_p95"))
    )
    return brackets.join(p95, by, "left").select(
        by, "n",
        F.round("_avg", 2).alias("avg_latency_ms"),
        F.round("_p95", 2).alias("p95_latency_ms"),
    )


def bracketed(timed: DataFrame, by: str, margin: float, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Per group a bracket of values around the 95th percentile, and the histogram of what lies in it."""
    ends = [max(0.0, 0.95 - margin), min(1.0, 0.95 + margin)]
    brackets = materialise(
        timed.groupBy(by)
        .agg(
            F.count("*").alias("n"),
            F.sum("_v").alias("_sum"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_b"),
        )
        .select(
            by, "n", (F.col("_sum") / F.col("n")).alias("_avg"),
            (F.col("_min") if margin >= 1 else F.col("_b")[0]).alias("_lo"),
            (F.col("_max") if margin >= 1 else F.col("_b")[1]).alias("_hi"),
            F.floor(F.col("n") * F.lit(0.95)).cast("long").alias("_rank"),
        )
    )
    near = join_by_size(timed, brackets, [by], "inner", byte_size(brackets), ["_v"])
    # Values below the bracket share one entry, so the histogram holds the bracket alone.
    histogram = (
        near.filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(by, "_v").agg(F.count("*").alias("_k"), F.first("_rank").alias("_rank"))
    )
    return brackets, materialise(histogram)


def evaluation_report(scored: DataFrame, by: str, latency: str | None = None) -> DataFrame:
    """One row per model: counts, metrics, latency figures if there are any, and the wall time.

    ``scored`` is evaluated here, once, since the time it takes is part of the result.
    """
    start = time.perf_counter()
    kept = [by, "label", "pred", *([latency] if latency else [])]
    rows = materialise(scored.select(*kept))
    metrics = materialise(binary_metrics(confusion_counts(rows, [by])))
    elapsed = round(time.perf_counter() - start, 2)
    report = metrics.withColumn("total_eval_time_seconds", F.lit(elapsed))
    if latency is None:
        return report
    stats = latency_stats(rows, by, latency).drop("n")
    return report.join(stats, by, "left")

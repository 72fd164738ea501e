"""Benchmark and metrics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.decision import fixed, percent, seconds


def all_metrics(registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every registered model with its metrics, null where there are none."""
    return registry.join(metrics, "model_key", "left")


def benchmark_table(registry: DataFrame, metrics: DataFrame, missing: str = "-") -> DataFrame:
    """Test figures, or validation figures where there are none; models without metrics drop out."""
    return (
        registry.join(metrics, "model_key", "inner")
        .select(
            "ord",
            F.coalesce("model", "model_key").alias("model"),
            percent(F.coalesce("test_accuracy", "val_accuracy"), missing).alias("accuracy"),
            fixed(F.coalesce("test_f1", "val_f1"), 3, missing=missing).alias("f1"),
            seconds(F.col("training_time_seconds"), missing).alias("train"),
        )
    )


def training_summary(metrics: DataFrame) -> DataFrame:
    """One line per trained model: test accuracy if there is one, else validation accuracy."""
    return metrics.select(
        "model",
        F.when(F.col("test_accuracy").isNotNull(), F.lit("test_accuracy")).otherwise(F.lit("val_accuracy")).alias("measure"),
        F.coalesce("test_accuracy", "val_accuracy").alias("value"),
    )

"""From a probability or logits to a verdict, and how a verdict is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = "positive"
NEGATIVE = "negative"


def label_to_int(sentiment: Column) -> Column:
    """positive 1, negative 0, anything else null; case matters."""
    return F.when(sentiment == POSITIVE, 1).when(sentiment == NEGATIVE, 0)


def predicted_int(label: Column) -> Column:
    """positive 1, every other label 0."""
    return F.when(label == POSITIVE, 1).otherwise(0)


def int_to_label(label: Column) -> Column:
    return F.when(label == 1, F.lit(POSITIVE)).when(label == 0, F.lit(NEGATIVE))


def verdict(p_pos: Column) -> Column:
    """positive only above one half; the tie is negative."""
    return F.when(p_pos > 0.5, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def confidence(p_pos: Column) -> Column:
    return F.when(p_pos > 0.5, p_pos).otherwise(1.0 - p_pos)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softmax2_positive(negative: Column, positive: Column) -> Column:
    """P(positive) of two logits, shifted by the larger one so exp cannot overflow."""
    top = F.greatest(negative, positive)
    e_pos = F.exp(positive - top)
    return e_pos / (e_pos + F.exp(negative - top))


def argmax(values: Column) -> Column:
    """Index of the first largest element, counted from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def prediction(p_pos: Column, latency_ms: Column | None = None) -> Column:
    """The prediction record; probabilities to 4 places, latency to 2."""
    latency = F.lit(0.0) if latency_ms is None else F.round(F.coalesce(latency_ms, F.lit(0.0)), 2)
    return F.struct(
        verdict(p_pos).alias("label"),
        F.round(confidence(p_pos), 4).alias("confidence"),
        F.struct(
            F.round(p_pos, 4).alias(POSITIVE),
            F.round(1.0 - p_pos, 4).alias(NEGATIVE),
        ).alias("probabilities"),
        latency.alias("latency_ms"),
    )


def legacy_verdict(text: Column, p_pos: Column) -> Column:
    """Older script: no text neutral, no score error, else the verdict."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("neutral"))
        .when(p_pos.isNull(), F.lit("error"))
        .otherwise(verdict(p_pos))
    )


def legacy_confidence(text: Column, p_pos: Column) -> Column:
    """Older script: P(positive) itself, whatever the verdict."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.5))
        .otherwise(F.coalesce(p_pos, F.lit(0.0)))
    )


def confidence_signal(conf: Column) -> Column:
    return F.when(conf >= 0.85, 3).when(conf >= 0.65, 2).when(conf >= 0.5, 1).otherwise(0)


def confidence_band(conf: Column) -> Column:
    return (
        F.when(conf >= 0.85, F.lit("High confidence"))
        .when(conf >= 0.65, F.lit("Moderate confidence"))
        .when(conf >= 0.5, F.lit("Low confidence"))
        .otherwise(F.lit("No signal"))
    )


def verdict_roles(label: Column, p_pos: Column, p_neg: Column) -> Column:
    """Both classes with the part each plays in the verdict."""
    def role(name: str, p: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.when(label == name, F.lit("Selected verdict")).otherwise(F.lit("Alternate class")).alias("role"),
            p.alias("probability"),
        )

    return F.array(role(POSITIVE, p_pos), role(NEGATIVE, p_neg))


def fixed(value: Column, digits: int, unit: str = "", missing: str = "-") -> Column:
    """Fixed-decimal text, halves rounded up, with a unit; ``missing`` for null.

    The digits come from a decimal, so no binary remainder decides a half.
    """
    return F.coalesce(
        F.concat(F.round(value.cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})").cast("string"), F.lit(unit)),
        F.lit(missing),
    )


def percent(value: Column, missing: str = "-") -> Column:
    return fixed(value.cast("decimal(28,10)") * 100, 1, "%", missing)


def millis(value: Column, missing: str = "-") -> Column:
    return fixed(value, 1, " ms", missing)


def seconds(value: Column, missing: str = "-") -> Column:
    return fixed(value, 1, " s", missing)

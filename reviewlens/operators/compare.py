"""Several models on the same texts."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewlens.functions.decision import confidence, verdict
from reviewlens.session import materialise


def timed(scores: DataFrame) -> DataFrame:
    """The scores, written, with ``latency_ms``: the time of the scoring job per text.

    The rows are counted by the job itself while it writes them, so measuring takes no pass of its own. All
    models are scored in one pass, so they share the figure.
    """
    seen = Observation()
    start = time.perf_counter()
    written = materialise(scores.observe(seen, F.count(F.lit(1)).alias("n")))
    elapsed = 1000 * (time.perf_counter() - start)
    return written.withColumn("latency_ms", F.lit(elapsed / max(seen.get["n"], 1)))


def to_long(scores: DataFrame, keys: list[str], models: dict[str, str], carry: list[str] = []) -> DataFrame:
    """One row per text and model from the wide scores; ``models`` maps keys to shown names."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("model_key"), F.lit(name).alias("model_name"), F.col(f"p_{k}").alias("p_pos"))
        for k, name in models.items()
    ])
    return scores.select(*keys, *carry, F.explode(entries).alias("m")).select(
        *keys, *carry,
        F.col("m.model_key").alias("model_key"),
        F.col("m.model_name").alias("model_name"),
        F.col("m.p_pos").alias("p_pos"),
        verdict(F.col("m.p_pos")).alias("verdict"),
        F.round(confidence(F.col("m.p_pos")), 4).alias("confidence"),
    )


def disagreement(scores: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Per text: every model's verdict, how many differ, and how far the scores lie apart.

    Works on the wide scores, so comparing models needs no shuffle of its own.
    """
    ps = [F.col(f"p_{m}") for m in models]
    verdicts: list[Column] = [verdict(p).alias(f"verdict_{m}") for m, p in zip(models, ps)]
    return scores.select(
        *keys,
        *verdicts,
        F.size(F.array_distinct(F.array(*verdicts))).cast("long").alias("n_verdicts"),
        F.round(F.greatest(*ps) - F.least(*ps), 6).alias("spread"),
    )


def disagreement_pattern(scores: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """How many texts show each combination of verdicts."""
    verdicts = [f"verdict_{m}" for m in models]
    return disagreement(scores, keys, models).groupBy(*verdicts).agg(F.count("*").alias("n_texts"))

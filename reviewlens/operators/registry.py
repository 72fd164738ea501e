"""Model registry as a small dimension table, availability and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model tiers in registry order, shown names and artefact folders.
MODELS = [
    (0, "baseline", "TF-IDF + Logistic Regression", "baseline"),
    (1, "lstm", "LSTM", "lstm"),
    (2, "transformer", "DistilBERT (ONNX)", "transformer_onnx"),
]

# What each tier saves, and whether scoring is impossible without it.
REQUIRED_ARTIFACTS = [
    ("baseline", "vocabulary", True),
    ("baseline", "classifier", True),
    ("baseline", "metrics", False),
    ("lstm", "word_index", True),
    ("lstm", "embedding", True),
    ("lstm", "network", True),
    ("lstm", "metrics", False),
    ("transformer_onnx", "model.onnx", True),
    ("transformer_onnx", "tokenizer.json", False),
    ("transformer_onnx", "tokenizer_config.json", True),
    ("transformer_onnx", "vocab.txt", False),
    ("transformer_onnx", "special_tokens_map.json", False),
    ("transformer_onnx", "metrics", False),
]


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "ord int, model_key string, model_name string, artifact_dir string")


def required_artifacts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIRED_ARTIFACTS, "artifact_dir string, artifact string, essential boolean")


def availability(registry: DataFrame, required: DataFrame, present: DataFrame) -> DataFrame:
    """(ord, model_key, available): every essential artefact of the model is there."""
    found = present.select("artifact_dir", "artifact").distinct().withColumn("_there", F.lit(True))
    return (
        registry.join(required.filter("essential"), "artifact_dir", "left")
        .join(found, ["artifact_dir", "artifact"], "left")
        .groupBy("ord", "model_key")
        .agg(F.every(F.coalesce("_there", F.lit(False))).alias("available"))
    )


def artifacts_by(present: DataFrame, by: list[str]) -> DataFrame:
    """(by, found): the registry's artefacts that each site has, as ``folder/name``; other files don't count.

    A site that has none of them keeps its row. There are few artefacts, so the group is small and is
    merged before the shuffle, however many files of one site are listed.
    """
    name = F.concat_ws("/", "artifact_dir", "artifact")
    known = name.isin([f"{folder}/{artifact}" for folder, artifact, _ in REQUIRED_ARTIFACTS])
    return present.groupBy(*by).agg(F.collect_set(F.when(known, name)).alias("found"))


def availability_by(present: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, model_key, available) for each site of ``present`` (by, artifact_dir, artifact)."""
    models = F.array(*[
        F.struct(F.lit(n).alias("ord"), F.lit(key).alias("model_key"), F.array(*[
            F.lit(f"{folder}/{artifact}") for folder, artifact, essential in REQUIRED_ARTIFACTS if essential and folder == own
        ]).alias("needs"))
        for n, key, _, own in MODELS
    ])
    return artifacts_by(present, by).select(*by, "found", F.inline(models)).select(
        *by, "ord", "model_key", (F.size(F.array_except("needs", "found")) == 0).alias("available"))


def missing_by(present: DataFrame, by: list[str]) -> DataFrame:
    """(by, artifact_dir, artifact) of what each site lacks."""
    required = F.array(*[F.lit(f"{folder}/{artifact}") for folder, artifact, _ in REQUIRED_ARTIFACTS])
    lacking = artifacts_by(present, by).select(*by, F.explode(F.array_except(required, "found")).alias("a"))
    return lacking.select(*by, F.split_part("a", F.lit("/"), F.lit(1)).alias("artifact_dir"),
                          F.split_part("a", F.lit("/"), F.lit(2)).alias("artifact"))


def model_lists(available: DataFrame, by: list[str] = []) -> DataFrame:
    """The available and the registered model keys, both in registry order; one row, or one per site."""
    def keys(only: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(only, F.struct("ord", "model_key"))))["model_key"]

    return available.groupBy(*by).agg(
        keys(F.col("available")).alias("models_available"),
        keys(F.lit(True)).alias("models_registered"),
    )


def missing_artifacts(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.join(present, ["artifact_dir", "artifact"], "left_anti").select("artifact_dir", "artifact")


def choose_models(requests: DataFrame, requested: str, available: DataFrame, default: str) -> DataFrame:
    """Resolve the model of every request.

    A named model is used if available and refused with 404 if not. Without a name the
    default is used, else the first available one; with none at all the status is 503.
    The registry has one row per model, so it is broadcast.
    """
    ready = available.filter("available")
    # One key out of the registry's few rows.
    fallback = ready.agg(
        F.coalesce(
            F.max(F.when(F.col("model_key") == default, F.col("model_key"))),
            F.min_by("model_key", "ord"),
        ).alias("key")
    ).first()["key"]
    named = F.coalesce(F.col(requested), F.lit("")) != ""
    keys = ready.select(F.col("model_key").alias("_found"))
    return (
        requests.join(F.broadcast(keys), F.col(requested) == F.col("_found"), "left")
        .withColumn("model_key", F.when(named, F.col("_found")).otherwise(F.lit(fallback).cast("string")))
        .withColumn(
            "status",
            F.when(F.col("model_key").isNotNull(), 200).when(named, 404).otherwise(503),
        )
        .drop("_found")
    )

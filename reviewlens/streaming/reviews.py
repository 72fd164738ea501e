"""Scoring reviews as they arrive, and keeping running counts."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewlens.functions.decision import prediction
from reviewlens.operators.evaluate import binary_metrics, confusion_counts, with_prediction
from reviewlens.operators.tfidf import LinearModel, score
from reviewlens.operators.validate import validate_texts
from reviewlens.session import scratch_path
from reviewlens.sources.published import current, exists, manifest, new_version, write_once


def read_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the files a pattern matches, now and later."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def score_batch(
    batch: DataFrame, keys: list[str], text: str, model: LinearModel, low: int, high: int, labels: DataFrame | None = None,
    carry: list[str] = [],
) -> DataFrame:
    """Every row with status and reason; scores (p_pos, prediction) of the accepted ones, null for the rest.

    A row that is delivered twice, or shares its key or has none, is a row of its own. Scoring is the same
    relational job that scores tables, so the model's vocabulary may have any size. With ``labels`` (keys,
    quality) a known label is added; of that table only the batch's key range is read.
    """
    checked = validate_texts(batch, text, low, high).withColumn(text, F.when(F.col("valid"), F.col(text)))
    scored = score(checked, keys, text, model, [*carry, "status", "reason"])
    fit = F.col("status") == 200
    out = scored.select(
        *keys, *carry, "status", "reason", F.lit(model.key).alias("model_key"), F.when(fit, F.col("p_pos")).alias("p_pos"),
        F.when(fit, prediction(F.col("p_pos"))).alias("prediction"))
    if labels is None:
        return out
    ends = batch.agg(F.min(keys[0]), F.max(keys[0])).first()
    known = labels.filter(F.col(keys[0]).between(*ends)).select(*keys, F.col("quality").alias("label"))
    return out.join(known, keys, "left")


LOG = "number bigint, folder string"


def log_file(path: str, checkpoint: str, number: int) -> str:
    """Where a micro-batch is named once it is written. Batches of streams with other checkpoints have other names."""
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    return f"{path}/log/{stream}-{number:010d}.json"


def score_to(
    reviews: DataFrame, keys: list[str], text: str, model: LinearModel, low: int, high: int, path: str, checkpoint: str,
    labels: DataFrame | None = None, carry: list[str] = [],
) -> StreamingQuery:
    """Score micro-batches into a folder each, and name the folder in a log when it is whole.

    Readers take the folders that the log names. A batch that is run again after it was named is passed over;
    one that was left half written is written anew, under another name.
    """
    spark = reviews.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        entry = log_file(path, checkpoint, number)
        if exists(spark, entry):
            return
        folder = f"{number}-{uuid.uuid4().hex}"
        rows = score_batch(batch, keys, text, model, low, high, labels, carry)
        rows.write.parquet(f"{path}/data/{folder}")
        write_once(spark, entry, json.dumps({"number": number, "folder": folder}))

    return (
        reviews.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def scored_schema(reviews: DataFrame, keys: list[str], labelled: bool = False, carry: list[str] = []) -> str:
    own = ", ".join(f"`{k}` {reviews.schema[k].dataType.simpleString()}" for k in [*keys, *carry])
    return (
        f"{own}, status int, reason string, model_key string, p_pos double, prediction struct<label: string, "
        "confidence: double, probabilities: struct<positive: double, negative: double>, latency_ms: double>"
        + (", label int" if labelled else "")
    )


def score_available(
    spark: SparkSession, reviews: DataFrame, keys: list[str], text: str, model: LinearModel, low: int, high: int,
    labels: DataFrame | None = None, carry: list[str] = [],
) -> str:
    """Run the stream over everything there now; the folder it wrote."""
    out = scratch_path(spark, "stream-scores")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    score_to(reviews, keys, text, model, low, high, out, checkpoint, labels, carry).awaitTermination()
    return out


def read_folders(spark: SparkSession, path: str, folders: list[str], schema: str) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{folder}" for folder in folders))


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The scores of all batches that the log names; one name per batch comes to the driver."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], schema)
    named = spark.read.schema(LOG).json(f"{path}/log").select("folder").collect()
    return read_folders(spark, path, sorted(r["folder"] for r in named), schema)


def running_confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts that grow with the stream; the state is one row per group."""
    return confusion_counts(with_prediction(scored), by)


STATE = "model_key string, label int, pred int, latency_ms double, n bigint"


def outcome_counts(scored: DataFrame, latency: str | None = None) -> DataFrame:
    """STATE: how many labelled scores there are of each outcome and latency, in hundredths of a millisecond."""
    time = F.round(F.col(latency), 2) if latency else F.lit(None)
    rows = with_prediction(scored.filter("p_pos IS NOT NULL AND label IS NOT NULL"))
    return rows.groupBy("model_key", "label", "pred", time.cast("double").alias("latency_ms")).agg(F.count("*").alias("n"))


def merged(counts: DataFrame, more: DataFrame) -> DataFrame:
    keys = [c.split()[0] for c in STATE.split(", ")][:-1]
    return counts.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))


def track_metrics(
    spark: SparkSession, scores: str, schema: str, table: str, checkpoint: str, latency: str | None = None,
    batches_per_trigger: int = 100,
) -> StreamingQuery:
    """Keep a table of outcome counts up to date with the scores that a stream writes.

    The source is the log of scored batches, so a batch counts once it is whole. The table is an additive
    histogram of outcomes and latencies, so all metrics and exact percentiles follow from it and it grows with
    the number of different latencies, not of scores. Each micro-batch merges its counts into a new version
    of the table and publishes it with its own number; one that is run again after that changes nothing.
    """
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", batches_per_trigger).json(f"{scores}/log")

    def merge(batch: DataFrame, number: int) -> None:
        if manifest(spark, table).get("number", -1) >= number:
            return
        # At most batches_per_trigger names.
        folders = [r["folder"] for r in batch.select("folder").collect()]
        new = outcome_counts(read_folders(spark, scores, folders, schema), latency)
        before = read_metrics_state(spark, table)
        with new_version(spark, table, number=number) as path:
            merged(before, new).write.parquet(path)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics_state(spark: SparkSession, table: str) -> DataFrame:
    if not manifest(spark, table):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(current(spark, table))


def state_confusion(state: DataFrame) -> DataFrame:
    """The confusion counts of each model from its outcome counts."""
    def count(condition: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0)).cast("long")

    return state.groupBy("model_key").agg(
        F.sum("n").cast("long").alias("total"), count("pred = label").alias("correct"),
        count("pred = 1 AND label = 1").alias("tp"), count("pred = 1 AND label = 0").alias("fp"),
        count("pred = 0 AND label = 0").alias("tn"), count("pred = 0 AND label = 1").alias("fn"))


def state_latency(state: DataFrame) -> DataFrame:
    """Mean and 95th percentile per model: the sorted value at floor(0.95 n), counted from 0; exact.

    What is ranked are the different latencies of a model, each with its count.
    """
    values = state.filter("latency_ms IS NOT NULL").groupBy("model_key", "latency_ms").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("model_key").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy("model_key")))
    rank = F.floor(F.col("_all") * F.lit(0.95))
    return ranked.groupBy("model_key").agg(
        F.round(F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n"), 2).alias("avg_latency_ms"),
        F.round(F.min(F.when(F.col("_upto") > rank, F.col("latency_ms"))), 2).alias("p95_latency_ms"))


def running_report(spark: SparkSession, table: str) -> DataFrame:
    """Counts, metrics and latency figures of each model up to the batch that was published last."""
    state = read_metrics_state(spark, table)
    return binary_metrics(state_confusion(state)).join(state_latency(state), "model_key", "left")

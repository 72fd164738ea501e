"""Saved models and their metrics, as tables in one folder per model."""

from __future__ import annotations

import re

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from reviewlens.functions.tokens import CLEANED, WORD_PATHS
from reviewlens.operators.tfidf import LinearModel
from reviewlens.operators.training import TrainedEmbedding
from reviewlens.operators.vocabulary import Vocabulary, WordIndex
from reviewlens.schemas import METRICS
from reviewlens.session import byte_size
from reviewlens.sources.published import MANIFEST, VERSIONS, current, new_version


REPORT = "classification_report"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(f"model artefact {path} not found; train the model first") from missing
        raise


VOCABULARY = "term string, ctf bigint, df bigint, term_id int, idf double, coef double"
CLASSIFIER = "key string, intercept double, n_docs bigint, n_pos bigint, ngram_low int, ngram_high int, path string"


def save_linear_model(model: LinearModel, folder: str, metrics: DataFrame | None = None) -> None:
    """Vocabulary, classifier and metrics become visible together, as a new version of the folder."""
    vocab = model.vocab
    spark = vocab.table.sparkSession
    columns = [c.split()[0] for c in VOCABULARY.split(", ")]
    row = (model.key, float(model.intercept), vocab.n_docs, vocab.n_pos, *vocab.ngram_range, vocab.path.name)
    with new_version(spark, folder) as path:
        vocab.table.select(*columns).write.parquet(f"{path}/vocabulary")
        spark.createDataFrame([row], CLASSIFIER).coalesce(1).write.parquet(f"{path}/classifier")
        if metrics is not None:
            save_metrics(metrics, path)


def load_linear_model(spark: SparkSession, folder: str) -> LinearModel:
    path = current(spark, folder)
    table = _read(spark, f"{path}/vocabulary", VOCABULARY)
    head = _read(spark, f"{path}/classifier", CLASSIFIER).first()
    vocab = Vocabulary(
        table, byte_size(table), table.count(), head["n_docs"], head["n_pos"], (head["ngram_low"], head["ngram_high"]),
        WORD_PATHS[head["path"] or CLEANED.name],
    )
    return LinearModel(head["key"], vocab, head["intercept"])


def save_word_index(index: WordIndex, folder: str) -> None:
    with new_version(index.table.sparkSession, folder) as path:
        index.table.write.parquet(f"{path}/word_index")


def load_word_index(spark: SparkSession, folder: str, num_words: int) -> WordIndex:
    table = _read(spark, f"{current(spark, folder)}/word_index", "word string, idx int, cnt bigint")
    return WordIndex(table, byte_size(table), num_words)


def save_embedding_model(trained: TrainedEmbedding, folder: str, metrics: DataFrame | None = None) -> None:
    with new_version(trained.index.table.sparkSession, folder) as path:
        trained.index.table.write.parquet(f"{path}/word_index")
        trained.embedding.write().save(f"{path}/embedding")
        trained.classifier.write().save(f"{path}/network")
        if metrics is not None:
            save_metrics(metrics, path)


def load_embedding_model(spark: SparkSession, folder: str, num_words: int) -> TrainedEmbedding:
    index = load_word_index(spark, folder, num_words)
    path = current(spark, folder)
    return TrainedEmbedding(
        Word2VecModel.load(f"{path}/embedding"),
        MultilayerPerceptronClassificationModel.load(f"{path}/network"),
        index,
    )


def as_metrics(rows: DataFrame) -> DataFrame:
    """Bring metrics rows to the one wide schema; columns a model lacks become null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in METRICS.fields
    ])


def save_metrics(metrics: DataFrame, folder: str) -> None:
    """One row of metrics as JSON beside the artefacts."""
    as_metrics(metrics).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")


def read_metrics(spark: SparkSession, model_dir: str, registry: DataFrame) -> DataFrame:
    """(model_key, metrics columns) of every registered model that has metrics.

    They lie beside the artefacts, as ``metrics.json`` or in a folder ``metrics``; one file is one record,
    indented or not. Unknown keys are passed over, a malformed file fails the read.
    A model without a metrics file has no row; joined to the registry it shows as null.
    """
    # A nested report holds records per class and a plain number for the accuracy, so its values are read as text.
    nested = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([T.StructField(f.name, nested if f.name == REPORT else f.dataType) for f in METRICS.fields])
    files = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "FAILFAST").option(
        "multiLine", True).option("pathGlobFilter", "*.json").json(model_dir)
    place = artifact_place(F.col("_metadata.file_path"), model_dir)
    own = only_published(files.withColumns(place).filter("artifact IN ('metrics', 'metrics.json')"), published(spark, model_dir))
    own = own.withColumn(REPORT, F.transform_values(REPORT, lambda name, value: class_scores(value)))
    return own.join(F.broadcast(registry.select("artifact_dir", "model_key")), "artifact_dir").drop(*place)


def class_scores(value: Column) -> Column:
    """One entry of a classification report: a record with ``f1-score`` or ``f1_score``, or the accuracy alone."""
    record = F.from_json(value, "precision double, recall double, `f1-score` double, f1_score double, support double")
    alone = value.try_cast("double")
    return F.struct(
        record["precision"].alias("precision"), record["recall"].alias("recall"),
        F.coalesce(record["f1-score"], record["f1_score"], alone).alias("f1_score"),
        record["support"].cast("long").alias("support"))


def artifact_place(path: Column, model_dir: str) -> dict[str, Column]:
    """artifact_dir, version (null for a plain file of the folder) and artifact of a path below model_dir."""
    root = re.sub(r"^[a-z0-9]+:/*", "", model_dir).strip("/")
    parts = F.split(F.regexp_extract(path, rf"\Q{root}\E/(.*)$", 1), "/")
    versioned = F.get(parts, F.lit(1)) == VERSIONS
    return {
        "artifact_dir": F.get(parts, F.lit(0)),
        "version": F.when(versioned, F.get(parts, F.lit(2))),
        "artifact": F.when(versioned, F.get(parts, F.lit(3))).otherwise(F.get(parts, F.lit(1))),
    }


def published(spark: SparkSession, model_dir: str) -> DataFrame:
    """(artifact_dir, current): the published version of each folder that has versions, from its manifest."""
    manifests = spark.read.schema("version string").option("recursiveFileLookup", True).option(
        "pathGlobFilter", MANIFEST).option("multiLine", True).json(model_dir)
    place = artifact_place(F.col("_metadata.file_path"), model_dir)
    return manifests.select(place["artifact_dir"].alias("artifact_dir"), F.col("version").alias("current"))


def only_published(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of the published version; where there is none, all plain files, and metrics beside the versions."""
    plain = F.col("version").isNull() & (F.col("current").isNull() | F.col("artifact").isin("metrics", "metrics.json"))
    return files.join(versions, "artifact_dir", "left").filter(plain | (F.col("version") == F.col("current"))).drop("current")


def list_artifacts(spark: SparkSession, model_dir: str) -> DataFrame:
    """(artifact_dir, artifact) of what is published in a model folder; file contents are not read."""
    paths = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(model_dir).select("path")
    )
    files = paths.select(*(column.alias(name) for name, column in artifact_place(F.col("path"), model_dir).items()))
    found = only_published(files.filter(F.col("artifact").isNotNull() & (F.col("artifact") != MANIFEST)), published(spark, model_dir))
    return found.select("artifact_dir", "artifact").distinct()


def length_setting(saved: Column, default: int) -> Column:
    """A length restored from saved metrics, else the default."""
    return F.coalesce(saved, F.lit(default))


"""Training on Spark ML: TF-IDF with logistic regression, and embeddings with a perceptron."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.operators.evaluate import binary_metrics, class_report, confusion_counts, log_loss, with_prediction
from reviewlens.operators.sequences import text_sequences
from reviewlens.operators.tfidf import LinearModel, score, vector_table
from reviewlens.operators.vocabulary import WordIndex, fit_vocabulary, fit_word_index
from reviewlens.session import byte_size, join_by_size, materialise, scratch_path
from reviewlens.sources.published import current, list_names, manifest, new_version, read_file, write_once


# Least feature values per model weight in one training task.
VALUES_PER_WEIGHT = 16


@dataclass(frozen=True)
class TrainedBaseline:
    model: LinearModel
    classifier: LogisticRegressionModel
    seconds: float


def train_logreg(train: DataFrame, key: str, text: str, label: str, config: JobConfig = JobConfig()) -> TrainedBaseline:
    """L2 logistic regression on TF-IDF vectors, with a free intercept and unscaled features.

    Spark averages the loss over rows, so C becomes regParam = 1 / (C n).
    """
    start = time.perf_counter()
    vocab = fit_vocabulary(train, [key], text, config.max_features, config.ngram_range, label)
    vectors = vector_table(train, [key], text, vocab, [label])
    # Every task of every iteration ships one dense gradient, so a task should hold many
    # more values than the gradient has. Only small data is merged by this.
    n_values = vocab.table.agg(F.sum("df")).first()[0] or 0
    vectors = vectors.coalesce(max(1, n_values // (VALUES_PER_WEIGHT * max(vocab.size, 1))))
    classifier = LogisticRegression(
        labelCol=label, featuresCol="features", maxIter=config.max_iter,
        regParam=1.0 / (config.reg_c * vocab.n_docs), elasticNetParam=0.0,
        standardization=False, fitIntercept=True, aggregationDepth=2,
    ).fit(vectors)
    spark = train.sparkSession
    # A fitted classifier keeps a summary that refers to the session, which no task can be sent once
    # anything was observed in it; a saved and loaded one has none.
    path = scratch_path(spark, "classifier")
    classifier.write().save(path)
    classifier = LogisticRegressionModel.load(path)
    # One number per vocabulary entry: the fitted weights are as bounded as the vocabulary.
    weights = spark.createDataFrame(
        list(enumerate(map(float, classifier.coefficients.toArray()))), "term_id int, coef double"
    )
    table = materialise(join_by_size(vocab.table, weights, ["term_id"], "inner", 16 * vocab.size, ["term_id"]))
    model = LinearModel("baseline", replace(vocab, table=table, size_bytes=byte_size(table)), float(classifier.intercept))
    return TrainedBaseline(model, classifier, time.perf_counter() - start)


def evaluate_linear(docs: DataFrame, key: str, text: str, label: str, model: LinearModel) -> DataFrame:
    """Confusion counts of one model on one table."""
    scored = with_prediction(score(docs, [key], text, model, [label]))
    return confusion_counts(scored, [], label)


def quality(counts: DataFrame, prefix: str) -> DataFrame:
    return binary_metrics(counts, digits=None).select(
        F.col("accuracy").alias(f"{prefix}_accuracy"), F.col("f1").alias(f"{prefix}_f1")
    )


def baseline_metrics(
    trained: TrainedBaseline, parts: dict[str, DataFrame], key: str, text: str, label: str, config: JobConfig = JobConfig()
) -> DataFrame:
    """One metrics row with accuracy and F1 of every given part (train, val, test).

    All parts are scored in one pass; a part without rows has null figures.
    """
    vocab = trained.model.vocab
    rows = None
    for name, part in parts.items():
        part = part.select(key, text, label, F.lit(name).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    scored = with_prediction(score(rows, [key, "part"], text, trained.model, [label]))
    counts = materialise(confusion_counts(scored, ["part"], label))
    figures = binary_metrics(counts, digits=None).agg(*[
        F.max(F.when(F.col("part") == name, F.col(measure))).alias(f"{name}_{measure}")
        for name in parts for measure in ("accuracy", "f1")
    ])
    settings = figures.select(
        F.lit("TF-IDF + Logistic Regression").alias("model"),
        "*",
        F.lit(round(trained.seconds, 2)).alias("training_time_seconds"),
        F.lit(vocab.size).cast("long").alias("vocab_size"),
        F.lit(config.max_features).alias("max_features"),
        F.array(*map(F.lit, config.ngram_range)).alias("ngram_range"),
        F.lit(config.reg_c).alias("C"),
    )
    if "test" not in parts:
        return settings
    report = class_report(counts.filter("part = 'test'"), [], digits=10).agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("class"), F.struct("precision", "recall", "f1_score", "support")
        ))).alias("classification_report")
    ).withColumn("model", F.lit("TF-IDF + Logistic Regression"))
    return settings.join(report, "model")  # one row each


@dataclass(frozen=True)
class TrainedEmbedding:
    embedding: Word2VecModel
    classifier: MultilayerPerceptronClassificationModel
    index: WordIndex
    history: list[tuple] = field(default_factory=list)
    best_epoch: int = 0
    seconds: float = 0.0


HISTORY = "epoch int, accuracy double, loss double, val_accuracy double, val_loss double"


def embed(docs: DataFrame, key: str, text: str, label: str, index: WordIndex, model: Word2VecModel, max_len: int) -> DataFrame:
    words = last_words(docs, key, text, label, index, max_len)
    return model.transform(words).select(key, label, "features")


def last_words(docs: DataFrame, key: str, text: str, label: str, index: WordIndex, max_len: int) -> DataFrame:
    """The last ``max_len`` known words of each text, the part a padded sequence keeps."""
    n = F.size("words")
    return text_sequences(docs, key, text, index, [label]).select(
        key, label,
        F.slice("words", F.greatest(n - F.lit(max_len), F.lit(0)) + 1, F.lit(max_len)).alias("words"),
    )


def class_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p_pos", vector_to_array("probability")[1])


def loss_and_accuracy(model: MultilayerPerceptronClassificationModel, data: DataFrame, label: str) -> tuple[float, float]:
    row = log_loss(class_probability(model.transform(data)), [], label).first()
    return row["loss"], row["accuracy"]


@dataclass(frozen=True)
class RoundLog:
    """Rounds of a fit in a folder of the shared store, each committed by one small file.

    ``base`` holds what all rounds start from, as a published version; ``networks`` the network of each round.
    """

    spark: SparkSession
    folder: str

    def base(self, num_words: int) -> tuple[WordIndex, Word2VecModel] | None:
        if not manifest(self.spark, f"{self.folder}/base"):
            return None
        path = current(self.spark, f"{self.folder}/base")
        table = self.spark.read.parquet(f"{path}/word_index")
        return WordIndex(table, byte_size(table), num_words), Word2VecModel.load(f"{path}/embedding")

    def save_base(self, index: WordIndex, embedding: Word2VecModel) -> None:
        with new_version(self.spark, f"{self.folder}/base") as path:
            index.table.write.parquet(f"{path}/word_index")
            embedding.write().save(f"{path}/embedding")

    def commit(self, row: tuple, model: MultilayerPerceptronClassificationModel) -> None:
        """The network first, then the file that names it; a round that was committed before stays as it is."""
        network = f"{self.folder}/networks/{row[0]}-{uuid.uuid4().hex}"
        model.write().save(network)
        write_once(self.spark, f"{self.folder}/rounds/{row[0]:06d}.json", json.dumps({"row": row, "network": network}))

    def committed(self) -> list[tuple[tuple, str]]:
        """(history row, network) of the rounds from the first on."""
        names = sorted(n for n in list_names(self.spark, f"{self.folder}/rounds") if n.endswith(".json"))
        rounds = [json.loads(read_file(self.spark, f"{self.folder}/rounds/{name}")) for name in names]
        return [(tuple(r["row"]), r["network"]) for r in rounds]


def train_embedding(
    train: DataFrame, val: DataFrame, key: str, text: str, label: str, config: JobConfig = JobConfig(),
    rounds: str | None = None,
) -> TrainedEmbedding:
    """Word embeddings averaged per text, then a perceptron, with early stopping.

    Only words of the bounded index are embedded, so the embedding table has at most
    num_words rows. Each round continues from the last weights for a few iterations; it
    stops after ``patience`` rounds without a better validation loss and keeps the best.
    With a folder for ``rounds``, embedding and rounds are committed there, and a fit that
    was stopped goes on after its last committed round; it must get the same texts.
    """
    start = time.perf_counter()
    log = RoundLog(train.sparkSession, rounds.rstrip("/")) if rounds else None
    before = log.base(config.num_words) if log else None
    index = before[0] if before else fit_word_index(train.select(key, text), key, text, config.num_words)
    words = materialise(last_words(train, key, text, label, index, config.max_len))
    if before:
        embedding = before[1]
    else:
        # The default of one learner would pull all texts into a single task. Their number shapes the
        # fitted vectors, so it is a parameter of the model and not of the cluster.
        embedding = Word2Vec(
            vectorSize=config.embedding_dim, minCount=0, maxIter=1, seed=config.seed,
            numPartitions=config.embedding_parts,
            inputCol="words", outputCol="features",
        ).fit(words)
        if log:
            log.save_base(index, embedding)
    train_set = materialise(embedding.transform(words).select(key, label, "features"))
    val_set = materialise(embed(val, key, text, label, index, embedding, config.max_len))

    layers = [config.embedding_dim, config.hidden_units, 2]
    weights, best, best_loss, best_epoch, history = None, None, np.inf, 0, []

    def judge(row: tuple, model: MultilayerPerceptronClassificationModel) -> None:
        nonlocal weights, best, best_loss, best_epoch
        history.append(row)
        weights = model.weights
        if row[4] < best_loss:
            best, best_loss, best_epoch = model, row[4], row[0]

    for row, network in log.committed() if log else []:
        judge(row, MultilayerPerceptronClassificationModel.load(network))
    for epoch in range(len(history) + 1, config.epochs + 1):
        if epoch - 1 - best_epoch >= config.patience:
            break
        learner = MultilayerPerceptronClassifier(
            labelCol=label, featuresCol="features", layers=layers, maxIter=config.epoch_iterations, seed=config.seed, solver="l-bfgs"
        )
        if weights is not None:
            learner = learner.setInitialWeights(weights)
        model = learner.fit(train_set)
        loss, accuracy = loss_and_accuracy(model, train_set, label)
        val_loss, val_accuracy = loss_and_accuracy(model, val_set, label)
        judge((epoch, accuracy, loss, val_accuracy, val_loss), model)
        if log:
            log.commit(history[-1], model)
    return TrainedEmbedding(embedding, best, index, history, best_epoch, time.perf_counter() - start)


def history_table(trained: TrainedEmbedding) -> DataFrame:
    """One row per round, at most ``epochs`` of them."""
    return trained.index.table.sparkSession.createDataFrame(trained.history, HISTORY)


def score_embedding(
    docs: DataFrame, key: str, text: str, label: str, trained: TrainedEmbedding, config: JobConfig = JobConfig()
) -> DataFrame:
    """(key, label, p_pos, ...) of the embedding tier."""
    features = embed(docs, key, text, label, trained.index, trained.embedding, config.max_len)
    return class_probability(trained.classifier.transform(features))


def embedding_metrics(
    trained: TrainedEmbedding, val: DataFrame, key: str, text: str, label: str, config: JobConfig = JobConfig()
) -> DataFrame:
    scored = score_embedding(val, key, text, label, trained, config)
    return log_loss(scored, [], label).select(
        F.lit("Embedding + MLP").alias("model"),
        F.col("accuracy").alias("val_accuracy"),
        F.col("loss").alias("val_loss"),
        F.lit(round(trained.seconds, 2)).alias("training_time_seconds"),
        F.lit(len(trained.history)).alias("epochs_completed"),
        F.lit(config.num_words).alias("num_words"),
        F.lit(config.max_len).alias("max_len"),
        F.lit(config.embedding_dim).alias("embedding_dim"),
        F.lit(config.hidden_units).alias("hidden_units"),
    )


def train_targets(
    target: str, splits: DataFrame, key: str, text: str, label: str, config: JobConfig = JobConfig(),
    folder: str | None = None,
) -> DataFrame:
    """Train ``baseline``, ``lstm`` (the embedding tier) or ``all``; metrics rows in the wide schema.

    With ``folder`` each tier's artefacts and metrics are saved below it, where the registry looks for them.
    """
    from reviewlens.sources.models import as_metrics, save_embedding_model, save_linear_model

    if target not in ("baseline", "lstm", "all"):
        raise ValueError(f"unknown target {target!r}; use baseline, lstm or all")
    train, val, test = (splits.filter(F.col("split") == s) for s in ("train", "val", "test"))
    rows = []
    if target in ("baseline", "all"):
        trained = train_logreg(train, key, text, label, config)
        rows.append(as_metrics(
            baseline_metrics(trained, {"train": train, "val": val, "test": test}, key, text, label, config)
        ).withColumn("model_key", F.lit("baseline")))
        if folder:
            save_linear_model(trained.model, f"{folder}/baseline", rows[-1])
    if target in ("lstm", "all"):
        trained = train_embedding(train, val, key, text, label, config)
        rows.append(as_metrics(
            embedding_metrics(trained, val, key, text, label, config)
        ).withColumn("model_key", F.lit("lstm")))
        if folder:
            save_embedding_model(trained, f"{folder}/lstm", rows[-1])
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

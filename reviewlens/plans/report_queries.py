"""Queries on saved models, metrics, availability and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.functions.decision import verdict
from reviewlens.operators import evaluate as E
from reviewlens.operators import registry, report, tfidf
from reviewlens.operators.sequences import text_sequences
from reviewlens.operators.tfidf import LinearModel
from reviewlens.operators.vocabulary import fit_word_index
from reviewlens.plans import oracle as O
from reviewlens.plans.text_queries import three_parts
from reviewlens.session import materialise, scratch_path
from reviewlens.sources import models as M
from reviewlens.sources import reviews as R

CONFIG = JobConfig()
KEY = ["doc_id"]


def _model(docs: DataFrame, key: str, ngram_range: tuple[int, int]) -> LinearModel:
    return tfidf.class_log_odds_model(docs, KEY, "text", "label", CONFIG.max_features, ngram_range, key)


def saved_models(spark: SparkSession, sf: str) -> str:
    """A model folder with a whole baseline tier and half of the sequence tier."""
    folder = scratch_path(spark, "models")
    docs = R.labelled_reviews(spark, sf)
    M.save_linear_model(_model(docs, "baseline", CONFIG.ngram_range), f"{folder}/baseline")
    index = fit_word_index(docs, "doc_id", "text", CONFIG.num_words)
    M.save_word_index(index, f"{folder}/lstm")
    return folder


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """(source, artifact_dir, artifact): sources as sites. Each labelled document brings one artefact of the list to
    its source, by its number, if it is of good quality; else a file that the registry doesn't know."""
    names = F.array(*[F.struct(F.lit(d).alias("artifact_dir"), F.lit(a).alias("artifact")) for d, a, _ in registry.REQUIRED_ARTIFACTS])
    own = F.get(names, (F.col("doc_id") % len(registry.REQUIRED_ARTIFACTS)).cast("int"))
    return R.labelled_reviews(spark, sf).select(
        "source", own["artifact_dir"].alias("artifact_dir"), F.when(F.col("label") == 1, own["artifact"]).otherwise("notes.txt").alias("artifact"))


def availability(spark: SparkSession, sf: str) -> DataFrame:
    return registry.availability_by(deliveries(spark, sf), ["source"])


def model_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = registry.model_lists(availability(spark, sf), ["source"])
    return lists.select("source", *[F.array_join(c, " ").alias(c) for c in lists.columns[1:]])


def missing_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return registry.missing_by(deliveries(spark, sf), ["source"])


def _part_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of two tiers fitted on train: one with test figures, one with validation only."""
    parts = three_parts(spark, sf).select("doc_id", "text", "label", "split")
    train = parts.filter("split = 'train'")
    models = tfidf.class_log_odds_models(train, KEY, "text", "label", {
        "baseline": (CONFIG.max_features, CONFIG.ngram_range), "lstm": (CONFIG.max_features, (1, 1)),
    })
    scores = tfidf.score_models(parts, KEY, "text", models, ["label", "split"])
    tiers = F.explode(F.array(*[
        F.struct(F.lit(m.key).alias("model_key"), F.col(f"p_{m.key}").alias("p_pos")) for m in models
    ]))
    scored = scores.select("label", "split", tiers.alias("t")).select("label", "split", "t.*")
    # The sequence tier has no test figures.
    scored = scored.filter((F.col("split") != "test") | (F.col("model_key") != "lstm"))
    figures = E.binary_metrics(E.confusion_counts(E.with_prediction(scored), ["model_key", "split"]), digits=None)
    return figures.groupBy("model_key").agg(*[
        F.max(F.when(F.col("split") == s, F.col(source))).alias(f"{s}_{target}")
        for s in ("train", "val", "test") for source, target in (("accuracy", "accuracy"), ("f1", "f1"))
    ])


def _saved_metrics(spark: SparkSession, sf: str) -> str:
    """Write each tier's metrics as JSON into its folder."""
    folder = scratch_path(spark, "metrics")
    metrics = materialise(_part_metrics(spark, sf).withColumn("model", F.col("model_key")))
    for key, directory in (("baseline", "baseline"), ("lstm", "lstm")):
        M.save_metrics(metrics.filter(F.col("model_key") == key), f"{folder}/{directory}")
    return folder


FIGURES = [f"{s}_{m}" for s in ("train", "val", "test") for m in ("accuracy", "f1")]


def metrics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    back = M.read_metrics(spark, _saved_metrics(spark, sf), registry.registry_table(spark))
    return back.select("model_key", *[F.round(c, 6).alias(c) for c in FIGURES])


def metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    table = registry.registry_table(spark)
    every = report.all_metrics(table, M.read_metrics(spark, _saved_metrics(spark, sf), table))
    return every.select("ord", "model_key", *[F.round(c, 6).alias(c) for c in FIGURES])


def benchmark_table(spark: SparkSession, sf: str) -> DataFrame:
    table = registry.registry_table(spark)
    return report.benchmark_table(table, M.read_metrics(spark, _saved_metrics(spark, sf), table))


def model_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a model that was saved and loaded, next to the original's."""
    docs = R.labelled_reviews(spark, sf)
    model = _model(docs, "original", CONFIG.ngram_range)
    folder = scratch_path(spark, "saved") + "/baseline"
    M.save_linear_model(model, folder)
    loaded = replace(M.load_linear_model(spark, folder), key="loaded")
    both = tfidf.score_models(docs, KEY, "text", [model, loaded])
    return both.select(
        "doc_id",
        F.round("p_loaded", 6).alias("p_pos"),
        (verdict(F.col("p_original")) == verdict(F.col("p_loaded"))).alias("same_verdict"),
        (F.abs(F.col("p_original") - F.col("p_loaded")) < 0.001).alias("close"),
    )


def max_len_from_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Saved sequence length (here the mean number of known words) applied to every text."""
    docs = R.read_documents(spark, sf).select("doc_id", "text")
    index = fit_word_index(docs, "doc_id", "text", CONFIG.num_words)
    lengths = materialise(text_sequences(docs, "doc_id", "text", index).select("doc_id", F.size("ids").alias("n_ids")))
    folder = scratch_path(spark, "metrics")
    M.save_metrics(
        lengths.agg(F.ceil(F.avg("n_ids")).cast("int").alias("max_len")).withColumn("model", F.lit("LSTM")),
        f"{folder}/lstm",
    )
    table = registry.registry_table(spark)
    saved = report.all_metrics(table, M.read_metrics(spark, folder, table))
    settings = saved.filter(F.col("model_key").isin("lstm", "transformer")).select(
        "model_key",
        F.when(F.col("model_key") == "lstm", M.length_setting(F.col("max_len"), CONFIG.max_len))
        .otherwise(M.length_setting(F.col("max_length"), CONFIG.max_length)).alias("length"),
    )
    # One setting per model of the registry.
    per_model = F.array(*[
        F.struct(F.lit(r["model_key"]).alias("model_key"), F.lit(r["length"]).alias("length")) for r in settings.collect()
    ])
    return lengths.select("doc_id", "n_ids", F.inline(per_model)).select(
        "doc_id", "model_key", "length", F.least("n_ids", "length").alias("n_kept")
    )


QUERIES = {
    f.__name__: f
    for f in (
        availability, model_lists, missing_artifacts, metrics_roundtrip, metrics_all, benchmark_table,
        model_save_load, max_len_from_metrics,
    )
}

_REGISTRY = "reg AS (SELECT * FROM (VALUES (0, 'baseline'), (1, 'lstm'), (2, 'transformer')) r(ord, model_key))"


def _parts() -> list[str]:
    """fig: (model_key, figures per split) of both tiers."""
    return [
        O.DOCS,
        *O.three_parts("s", "docs"),
        "tr AS (SELECT * FROM s WHERE split = 'train')",
        *O.fit("f2", "tr"),
        *O.fit("f1", "tr", bigrams=False),
        *O.score("s2", "f2", "s"),
        *O.score("s1", "f1", "s", bigrams=False),
        """both_tiers AS (SELECT 'baseline' AS model_key, split, label, p FROM s2
  UNION ALL SELECT 'lstm', split, label, p FROM s1 WHERE split <> 'test')""",
        O.confusion("both_tiers", "model_key, split"),
        f"m AS (SELECT model_key, split, {O.ACCURACY} AS accuracy, {O.F1} AS f1 FROM cm)",
        "fig AS (SELECT model_key, " + ", ".join(
            f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("train", "val", "test") for m in ("accuracy", "f1")
        ) + " FROM m GROUP BY model_key)",
    ]


# What each tier needs, numbered as documents bring it.
_NEEDS = ", ".join(f"({i}, '{d}', '{a}', {str(e).lower()})" for i, (d, a, e) in enumerate(registry.REQUIRED_ARTIFACTS))
_SITES = [
    f"need AS (SELECT * FROM (VALUES {_NEEDS}) v(i, artifact_dir, artifact, essential))",
    """reg AS (SELECT * FROM (VALUES (0, 'baseline', 'baseline'), (1, 'lstm', 'lstm'), (2, 'transformer', 'transformer_onnx'))
  v(ord, model_key, artifact_dir))""",
    "brought AS (SELECT DISTINCT source, doc_id % 13 AS i FROM documents JOIN labels USING (doc_id) WHERE quality = 1)",
    "site AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id))",
    """each AS (SELECT site.source, need.*, brought.i IS NOT NULL AS there FROM site JOIN need ON true
  LEFT JOIN brought ON brought.source = site.source AND brought.i = need.i)""",
]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FIGURES)

ORACLES = {
    "availability": O.with_ctes(
        _SITES,
        """SELECT source, CAST(ord AS INTEGER) AS ord, model_key, count(*) FILTER (essential AND NOT there) = 0 AS available
FROM each JOIN reg USING (artifact_dir) GROUP BY source, ord, model_key""",
    ),
    "model_lists": O.with_ctes(
        [
            *_SITES,
            """av AS (SELECT source, ord, model_key, count(*) FILTER (essential AND NOT there) = 0 AS available
  FROM each JOIN reg USING (artifact_dir) GROUP BY source, ord, model_key)""",
        ],
        """SELECT source, coalesce(string_agg(model_key, ' ' ORDER BY ord) FILTER (available), '') AS models_available,
  string_agg(model_key, ' ' ORDER BY ord) AS models_registered FROM av GROUP BY source""",
    ),
    "missing_artifacts": O.with_ctes(_SITES, "SELECT source, artifact_dir, artifact FROM each WHERE NOT there"),
    "metrics_roundtrip": O.with_ctes(_parts(), f"SELECT model_key, {_ROUNDED} FROM fig"),
    "metrics_all": O.with_ctes(
        [*_parts(), _REGISTRY],
        f"SELECT CAST(ord AS INTEGER) AS ord, reg.model_key, {_ROUNDED} FROM reg LEFT JOIN fig ON reg.model_key = fig.model_key",
    ),
    "benchmark_table": O.with_ctes(
        [*_parts(), _REGISTRY],
        f"""SELECT CAST(ord AS INTEGER) AS ord, reg.model_key AS model, {O.percent('coalesce(test_accuracy, val_accuracy)')} AS accuracy,
  {O.fixed('coalesce(test_f1, val_f1)', 3)} AS f1, '-' AS train FROM reg JOIN fig ON reg.model_key = fig.model_key""",
    ),
    "model_save_load": O.with_ctes(
        O.scored_docs(), "SELECT doc_id, round(p, 6) AS p_pos, true AS same_verdict, true AS close FROM scored"
    ),
}


def _max_len_sql() -> str:
    from reviewlens.plans.feature_queries import _INDEX

    return O.with_ctes(
        [
            *_INDEX,
            "n AS (SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids FROM seq)",
            """st AS (SELECT 'lstm' AS model_key, CAST((SELECT ceil(avg(n_ids)) FROM n) AS INTEGER) AS length
  UNION ALL SELECT 'transformer', 256)""",
        ],
        "SELECT doc_id, model_key, length, least(n_ids, length) AS n_kept FROM n, st",
    )


ORACLES["max_len_from_metrics"] = _max_len_sql()

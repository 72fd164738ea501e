"""Queries on scoring, decisions, validation, comparison and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.functions import decision as D
from reviewlens.functions.text import strip_whitespace
from reviewlens.operators import batches, compare, evaluate as E, registry, scorers, tfidf, validate
from reviewlens.operators.tfidf import LinearModel
from reviewlens.plans import oracle as O
from reviewlens.plans.feature_queries import REPEATED, repeated
from reviewlens.plans.report_queries import saved_models
from reviewlens.sources import models as M
from reviewlens.sources import reviews as R

CONFIG = JobConfig()
KEY = ["doc_id"]
MODELS = O.MODEL_NAMES


def log_odds_model(docs: DataFrame) -> LinearModel:
    return tfidf.class_log_odds_model(docs, KEY, "text", "label", CONFIG.max_features, CONFIG.ngram_range)


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf)
    return tfidf.score(docs, KEY, "text", log_odds_model(docs), ["label"])


def scored_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, scored by the model that was fitted on the labelled ones."""
    return tfidf.score(R.read_documents(spark, sf), KEY, "text", log_odds_model(R.labelled_reviews(spark, sf)))


def three_scorers(docs: DataFrame) -> list[LinearModel]:
    models = tfidf.class_log_odds_models(docs, KEY, "text", "label", {
        "tfidf_bigram": (CONFIG.max_features, CONFIG.ngram_range),
        "tfidf_unigram": (CONFIG.max_features, (1, 1)),
    })
    vocab = models[0].vocab
    return [*models, tfidf.class_prior_model(vocab.n_docs, vocab.n_pos)]


def wide_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the scores of three models fitted on the labelled ones."""
    return tfidf.score_models(R.read_documents(spark, sf), KEY, "text", three_scorers(R.labelled_reviews(spark, sf)))


def wide_scores(spark: SparkSession, sf: str, carry: list[str] = ["label"]) -> DataFrame:
    # A stand-in latency that does not vary from run to run.
    docs = R.labelled_reviews(spark, sf).withColumn("latency_ms", F.round(F.length("text") / F.lit(100.0), 2))
    return tfidf.score_models(docs, KEY, "text", three_scorers(docs), carry)


def linear_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_all(spark, sf).select("doc_id", F.round("p_pos", 6).alias("p_pos"))


def scores_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One score per row, also where rows share a key or have none."""
    scored = tfidf.score(repeated(spark, sf), KEY, "text", log_odds_model(R.labelled_reviews(spark, sf)))
    return scored.select("doc_id", F.round("p_pos", 6).alias("p_pos"))


def score_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whole, and reduced to their first tag, which cleaning leaves empty and so undecided."""
    pages = R.read_pages(spark, sf)
    rows = pages.select("page_id", F.lit("page").alias("part"), F.col("html").alias("text")).unionByName(
        pages.select("page_id", F.lit("tag").alias("part"), F.regexp_extract("html", "<[^>]+>", 0).alias("text")))
    scored = tfidf.score(rows, ["page_id", "part"], "text", log_odds_model(R.labelled_reviews(spark, sf)))
    return scored.select("page_id", "part", F.round("p_pos", 6).alias("p_pos"))


def decide(spark: SparkSession, sf: str) -> DataFrame:
    return scored_all(spark, sf).select("doc_id", D.prediction(F.col("p_pos")).alias("p")).select(
        "doc_id", "p.label", "p.confidence", "p.probabilities.positive", "p.probabilities.negative", "p.latency_ms"
    )


def legacy_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and, with its text blanked to a space or to nothing, every page; only the raw text decides
    what is empty, and what has no score counts as failed."""
    docs = R.read_documents(spark, sf).select("doc_id", "text").unionByName(
        R.read_pages(spark, sf).select(
            (-1 - F.col("page_id")).alias("doc_id"),
            F.when(F.col("html").contains("&"), " ").otherwise("").alias("text")))
    # Whether a text is empty shows in its first character; the text itself would be copied per word.
    tidy = docs.select("doc_id", strip_whitespace(F.lower("text")).alias("tidy"), F.substring("text", 1, 1).alias("head"))
    scored = tfidf.score(tidy, KEY, "tidy", log_odds_model(R.labelled_reviews(spark, sf)), ["head"])
    return scored.select(
        "doc_id",
        D.legacy_verdict(F.col("head"), F.col("p_pos")).alias("sentiment"),
        F.round(D.legacy_confidence(F.col("head"), F.col("p_pos")), 6).alias("confidence"),
    )


def read_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf}/embeddings.parquet")


def softmax2(spark: SparkSession, sf: str) -> DataFrame:
    logits = read_embeddings(spark, sf).select(
        "vec_id", F.col("embedding")[0].cast("double").alias("neg"), F.col("embedding")[1].cast("double").alias("pos")
    )
    p = D.softmax2_positive(F.col("neg"), F.col("pos"))
    return logits.select(
        "vec_id", F.round(p, 6).alias("p_pos"), F.round(1.0 - p, 6).alias("p_neg"), D.verdict(p).alias("label")
    )


def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return read_embeddings(spark, sf).select("vec_id", D.argmax(F.col("embedding")).alias("class"))


def batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as batches; their turns are the positions."""
    answers = batches.batch_predict(
        R.read_conversations(spark, sf), "conv_id", "turn", "text", log_odds_model(R.labelled_reviews(spark, sf)),
        CONFIG.batch_max_texts, CONFIG.text_max_chars,
    )
    return answers.select(
        "conv_id", "status", "model", "count",
        F.array_join("predictions.label", " ").alias("labels"),
        F.array_join(
            F.transform("predictions.confidence", lambda c: F.round(c * 10000).cast("long").cast("string")), " "
        ).alias("confidences"),
    )


def batch_repeated_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn twice at its position, and all first turns once more without a conversation."""
    turns = R.read_conversations(spark, sf).select("conv_id", "turn", "text")
    lost = turns.filter("turn = 0").select(F.lit(None).cast("long").alias("conv_id"), "turn", "text")
    answers = batches.batch_predict(
        turns.unionByName(turns).unionByName(lost), "conv_id", "turn", "text", log_odds_model(R.labelled_reviews(spark, sf)),
        CONFIG.batch_max_texts, CONFIG.text_max_chars)
    return answers.select("conv_id", "status", "count", F.array_join("predictions.label", " ").alias("labels"))


def scorer_map(spark: SparkSession, sf: str) -> DataFrame:
    """The linear model as a plugged-in scorer over every document."""
    scorer = scorers.LinearScorer.of(log_odds_model(R.labelled_reviews(spark, sf)))
    scored = scorers.score_texts(R.read_documents(spark, sf), KEY, "text", scorer)
    return scored.select(
        "doc_id", "model_name", F.round("p_pos", 6).alias("p_pos"), (F.col("latency_ms") >= 0).alias("timed")
    )


def model_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn asks for a model by its role; the folder decides what there is."""
    requests = R.read_conversations(spark, sf).select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "")
        .when(F.col("role") == "assistant", F.when(F.col("turn") < 4, "baseline").otherwise("transformer"))
        .otherwise("unheard-of").alias("requested"),
    )
    folder = saved_models(spark, sf)
    available = registry.availability(
        registry.registry_table(spark), registry.required_artifacts(spark), M.list_artifacts(spark, folder)
    )
    return registry.choose_models(requests, "requested", available, default=CONFIG.default_model)


def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and model, with the time the scoring took per text."""
    long = compare.to_long(compare.timed(wide_all(spark, sf)), KEY, MODELS, ["latency_ms"])
    return long.withColumn("p_pos", F.round("p_pos", 6)).withColumn("timed", F.col("latency_ms") > 0).drop("latency_ms")


def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return compare.disagreement(wide_all(spark, sf), KEY, list(MODELS))


def disagreement_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return compare.disagreement_pattern(wide_all(spark, sf), KEY, list(MODELS))


def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_all(spark, sf).select("doc_id", F.round(D.confidence(F.col("p_pos")), 4).alias("confidence"))
    return scored.select(
        "doc_id", "confidence",
        D.confidence_signal(F.col("confidence")).alias("signal"),
        D.confidence_band(F.col("confidence")).alias("band"),
    )


def verdict_roles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_pos")
    roles = D.verdict_roles(D.verdict(p), F.round(p, 4), F.round(1.0 - p, 4))
    return scored_all(spark, sf).select("doc_id", F.inline(roles))


def formatted_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shown figures of every document."""
    scored = scored_all(spark, sf).select("doc_id", F.round(D.confidence(F.col("p_pos")), 4).alias("c"))
    docs = R.read_documents(spark, sf).select("doc_id", "n_chars")
    return docs.join(scored, "doc_id", "left").select(
        "doc_id",
        D.percent(F.col("c")).alias("confidence"),
        D.fixed(F.col("c"), 3, missing="N/A").alias("confidence_3"),
        D.millis(F.col("n_chars") / F.lit(100.0)).alias("latency"),
    )


def validate_texts(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate.validate_texts(
        R.read_documents(spark, sf), "text", CONFIG.text_min_chars, CONFIG.text_max_chars
    )
    return checked.select("doc_id", "valid", "status", "reason")


def validate_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, and the documents of each source, as batches; with and without the item limit."""
    turns = R.read_conversations(spark, sf).select(F.concat(F.lit("conv"), "conv_id").alias("batch_id"), "text")
    docs = R.read_documents(spark, sf).select(F.col("source").alias("batch_id"), "text")
    rows = turns.unionByName(docs)
    sized = validate.validate_batches(rows, "batch_id", "text", CONFIG.batch_max_texts, CONFIG.text_max_chars)
    return sized.withColumn("strict_status", validate.batch_status(
        F.col("n"), F.col("n_too_long"), CONFIG.batch_max_texts, enforce_item_limit=True
    ))


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion_counts(E.with_prediction(scored_docs(spark, sf)), [])


def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _confusion(spark, sf)


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.binary_metrics(_confusion(spark, sf))


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_report(_confusion(spark, sf), [])


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion_matrix(_confusion(spark, sf), [])


def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return E.log_loss(scored_docs(spark, sf), []).select(
        "total", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy")
    )


def eval_by_model(spark: SparkSession, sf: str) -> DataFrame:
    scored = wide_scores(spark, sf)
    long = E.with_prediction(compare.to_long(scored, KEY, MODELS, ["label"]))
    return E.binary_metrics(E.confusion_counts(long, ["model_key"]))


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    carry = ["label", "latency_ms"]
    long = E.with_prediction(compare.to_long(wide_scores(spark, sf, carry), KEY, MODELS, carry))
    report = E.evaluation_report(long, "model_key", "latency_ms")
    return report.withColumn("timed", F.col("total_eval_time_seconds") >= 0).drop("total_eval_time_seconds")


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.schema("event_type string, value double").parquet(f"{sf}/events.parquet")
    return E.latency_stats(events.withColumnRenamed("event_type", "model_key"), "model_key", "value")


QUERIES = {
    f.__name__: f
    for f in (
        linear_scores, scores_repeated_keys, score_markup, decide, legacy_decide, softmax2, argmax_class, batch_predict, batch_repeated_positions, scorer_map, model_choice, compare_models, disagreement, disagreement_pattern, confidence_band, verdict_roles,
        formatted_report, validate_texts, validate_batches, confusion_counts, binary_metrics, class_report,
        confusion_matrix, log_loss, eval_by_model, evaluation_report, latency_stats,
    )
}

_SCORED = O.scored_docs()
_ALL = O.scored_docs("every")
_CM = [*_SCORED, O.confusion("scored")]
_CONF = f"round({O.confidence('p')}, 4)"


def _report_row(name: str, p: str, r: str, n: str) -> str:
    f1 = O.ratio(f"2.0 * {p} * {r}", f"({p} + {r})")
    return f"SELECT '{name}' AS class, {p} AS p, {r} AS r, {f1} AS f, CAST({n} AS BIGINT) AS support FROM cm"


ORACLES = {
    "linear_scores": O.with_ctes(_ALL, "SELECT doc_id, round(p, 6) AS p_pos FROM scored"),
    "scores_repeated_keys": O.with_ctes(
        [O.DOCS, *O.fit("bi", "docs"), REPEATED, *O.score("scored", "bi", "numbered", "rid")],
        "SELECT doc_id, round(p, 6) AS p_pos FROM scored",
    ),
    "score_markup": O.with_ctes(
        [
            O.DOCS,
            *O.fit("bi", "docs"),
            """rows AS (SELECT page_id, 'page' AS part, html AS text FROM pages
  UNION ALL SELECT page_id, 'tag', regexp_extract(html, '<[^>]+>') FROM pages)""",
            *O.score("scored", "bi", "rows", "page_id, part"),
        ],
        "SELECT page_id, part, round(p, 6) AS p_pos FROM scored",
    ),
    "decide": O.with_ctes(
        _ALL,
        f"""SELECT doc_id, {O.verdict('p')} AS label, {_CONF} AS confidence, round(p, 4) AS positive,
  round(1.0 - p, 4) AS negative, CAST(0.0 AS DOUBLE) AS latency_ms FROM scored""",
    ),
    "legacy_decide": O.with_ctes(
        [
            O.DOCS,
            *O.fit("bi", "docs"),
            """rows AS (SELECT doc_id, text, text AS raw FROM documents
  UNION ALL SELECT -1 - page_id, t, t FROM (SELECT page_id, CASE WHEN contains(html, '&') THEN ' ' ELSE '' END AS t FROM pages))""",
            *O.score("scored", "bi", "rows"),
        ],
        f"""SELECT doc_id, CASE WHEN raw = '' THEN 'neutral' WHEN p IS NULL THEN 'error' ELSE {O.verdict('p')} END AS sentiment,
  CASE WHEN raw = '' THEN 0.5 ELSE round(coalesce(p, 0.0), 6) END AS confidence FROM scored""",
    ),
    "softmax2": O.with_ctes(
        [
            "l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)",
            "s AS (SELECT vec_id, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p FROM l)",
        ],
        f"SELECT vec_id, round(p, 6) AS p_pos, round(1.0 - p, 6) AS p_neg, {O.verdict('p')} AS label FROM s",
    ),
    "argmax_class": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings",
    "batch_predict": O.with_ctes(
        [
            O.DOCS,
            *O.fit("bi", "docs"),
            "turns AS (SELECT conv_id, turn, text FROM conversations)",
            *O.score("st", "bi", "turns", "conv_id, turn"),
            """b AS (SELECT conv_id, CAST(CASE WHEN count(text) BETWEEN 1 AND 32 THEN 200 ELSE 422 END AS INTEGER) AS status,
  count(text) AS n FROM conversations GROUP BY conv_id)""",
            f"""g AS (SELECT conv_id, string_agg({O.verdict('p')}, ' ' ORDER BY turn) AS labels,
  string_agg(CAST(CAST(round({_CONF} * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY turn) AS confidences FROM st GROUP BY conv_id)""",
        ],
        """SELECT conv_id, status, CASE WHEN status = 200 THEN 'log_odds' END AS model, CASE WHEN status = 200 THEN n END AS count,
  CASE WHEN status = 200 THEN labels END AS labels, CASE WHEN status = 200 THEN confidences END AS confidences
FROM b JOIN g USING (conv_id)""",
    ),
    "batch_repeated_positions": O.with_ctes(
        [
            O.DOCS,
            *O.fit("bi", "docs"),
            """turns AS (SELECT row_number() OVER () AS rid, conv_id, turn, text FROM (SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT NULL, turn, text FROM conversations WHERE turn = 0))""",
            *O.score("st", "bi", "turns", "rid"),
            """b AS (SELECT conv_id, CAST(CASE WHEN count(text) BETWEEN 1 AND 32 THEN 200 ELSE 422 END AS INTEGER) AS status,
  count(text) AS n FROM turns GROUP BY conv_id)""",
            f"g AS (SELECT conv_id, string_agg({O.verdict('p')}, ' ' ORDER BY turn) AS labels FROM st GROUP BY conv_id)",
        ],
        """SELECT b.conv_id, status, CASE WHEN status = 200 THEN n END AS count, CASE WHEN status = 200 THEN labels END AS labels
FROM b JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id""",
    ),
    "scorer_map": O.with_ctes(
        _ALL,
        "SELECT doc_id, 'TF-IDF + Logistic Regression' AS model_name, round(p, 6) AS p_pos, true AS timed FROM scored",
    ),
    "model_choice": O.with_ctes(
        ["""r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '' WHEN 'assistant' THEN
  CASE WHEN turn < 4 THEN 'baseline' ELSE 'transformer' END ELSE 'unheard-of' END AS requested FROM conversations)"""],
        """SELECT conv_id, turn, requested, CASE WHEN requested IN ('', 'baseline') THEN 'baseline' END AS model_key,
  CAST(CASE WHEN requested IN ('', 'baseline') THEN 200 ELSE 404 END AS INTEGER) AS status FROM r""",
    ),
    "compare_models": O.with_ctes(
        O.long_models("every"),
        f"""SELECT doc_id, model_key, model_name, round(p, 6) AS p_pos, {O.verdict('p')} AS verdict,
  {_CONF} AS confidence, true AS timed FROM long""",
    ),
    "disagreement": O.with_ctes(
        O.three_models("every"),
        "SELECT doc_id, " + ", ".join(f"{O.verdict(f'p_{m}')} AS verdict_{m}" for m in O.MODEL_NAMES) + ", "
        + "CAST(len(list_distinct([" + ", ".join(O.verdict(f"p_{m}") for m in O.MODEL_NAMES) + "])) AS BIGINT) AS n_verdicts, "
        + "round(greatest(" + ", ".join(f"p_{m}" for m in O.MODEL_NAMES) + ") - least("
        + ", ".join(f"p_{m}" for m in O.MODEL_NAMES) + "), 6) AS spread FROM wide",
    ),
    "disagreement_pattern": O.with_ctes(
        O.three_models("every"),
        "SELECT " + ", ".join(f"{O.verdict(f'p_{m}')} AS verdict_{m}" for m in O.MODEL_NAMES)
        + ", count(*) AS n_texts FROM wide GROUP BY ALL",
    ),
    "confidence_band": O.with_ctes(
        [*_ALL, f"c AS (SELECT doc_id, {_CONF} AS confidence FROM scored)"],
        """SELECT doc_id, confidence,
  CAST(CASE WHEN confidence >= 0.85 THEN 3 WHEN confidence >= 0.65 THEN 2 WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS signal,
  CASE WHEN confidence >= 0.85 THEN 'High confidence' WHEN confidence >= 0.65 THEN 'Moderate confidence'
    WHEN confidence >= 0.5 THEN 'Low confidence' ELSE 'No signal' END AS band FROM c""",
    ),
    "verdict_roles": O.with_ctes(
        _ALL,
        """SELECT doc_id, 'positive' AS class, CASE WHEN p > 0.5 THEN 'Selected verdict' ELSE 'Alternate class' END AS role,
  round(p, 4) AS probability FROM scored
UNION ALL SELECT doc_id, 'negative', CASE WHEN p > 0.5 THEN 'Alternate class' ELSE 'Selected verdict' END,
  round(1.0 - p, 4) FROM scored""",
    ),
    "formatted_report": O.with_ctes(
        [*_ALL, f"c AS (SELECT doc_id, {_CONF} AS c FROM scored)"],
        f"""SELECT d.doc_id, {O.percent('c')} AS confidence, {O.fixed('c', 3, missing='N/A')} AS confidence_3,
  {O.fixed('n_chars / CAST(100.0 AS DOUBLE)', 1, ' ms')} AS latency
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""",
    ),
    "validate_texts": """SELECT doc_id, length(text) BETWEEN 1 AND 5000 AS valid,
  CAST(CASE WHEN length(text) BETWEEN 1 AND 5000 THEN 200 ELSE 422 END AS INTEGER) AS status,
  CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'too_short' WHEN length(text) > 5000 THEN 'too_long'
    ELSE 'ok' END AS reason FROM documents""",
    "validate_batches": O.with_ctes(
        [
            "r AS (SELECT 'conv' || conv_id AS batch_id, text FROM conversations UNION ALL SELECT source, text FROM documents)",
            """b AS (SELECT batch_id, count(text) AS n, count(*) FILTER (length(text) > 5000) AS n_too_long
  FROM r GROUP BY batch_id)""",
        ],
        """SELECT batch_id, n, n_too_long, CAST(CASE WHEN n < 1 OR n > 32 THEN 422 ELSE 200 END AS INTEGER) AS status,
  CAST(CASE WHEN n < 1 OR n > 32 OR n_too_long > 0 THEN 422 ELSE 200 END AS INTEGER) AS strict_status FROM b""",
    ),
    "confusion_counts": O.with_ctes(_CM, "SELECT * FROM cm"),
    "binary_metrics": O.with_ctes(_CM, f"SELECT *, {O.METRIC_COLUMNS} FROM cm"),
    "class_report": O.with_ctes(
        [
            *_CM,
            "k AS ("
            + _report_row("negative", O.ratio("tn", "tn + fn"), O.ratio("tn", "tn + fp"), "tn + fp")
            + " UNION ALL "
            + _report_row("positive", O.PRECISION, O.RECALL, "tp + fn")
            + ")",
        ],
        f"""SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score, support FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, round({O.ACCURACY}, 4), total FROM cm
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
  round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM k""",
    ),
    "confusion_matrix": O.with_ctes(
        _SCORED,
        """SELECT CAST(a AS INTEGER) AS actual, count(label) FILTER (NOT p > 0.5) AS predicted_0,
  count(label) FILTER (p > 0.5) AS predicted_1
FROM (SELECT unnest([0, 1]) AS a) LEFT JOIN scored ON label = a GROUP BY a""",
    ),
    "log_loss": O.with_ctes(
        [*_SCORED, "q AS (SELECT label, p AS p0, greatest(1e-7, least(1.0 - 1e-7, p)) AS p FROM scored)"],
        """SELECT count(*) AS total, round(avg(-(label * ln(p) + (1 - label) * ln(1.0 - p))), 6) AS loss,
  round(avg(CASE WHEN CAST(p0 > 0.5 AS INTEGER) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM q""",
    ),
    "eval_by_model": O.with_ctes(
        [*O.long_models(), O.confusion("long", "model_key")], f"SELECT *, {O.METRIC_COLUMNS} FROM cm"
    ),
    "evaluation_report": O.with_ctes(
        [
            *O.long_models(),
            O.confusion("long", "model_key"),
            f"m AS (SELECT *, {O.METRIC_COLUMNS} FROM cm)",
            """r AS (SELECT model_key, round(length(text) / CAST(100.0 AS DOUBLE), 2) AS v,
  row_number() OVER (PARTITION BY model_key ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY model_key) AS n
  FROM long JOIN docs USING (doc_id))""",
            """s AS (SELECT model_key, round(avg(v), 2) AS avg_latency_ms,
  round(max(v) FILTER (i = floor(n * CAST(0.95 AS DOUBLE))), 2) AS p95_latency_ms FROM r GROUP BY model_key)""",
        ],
        "SELECT m.*, avg_latency_ms, p95_latency_ms, true AS timed FROM m JOIN s ON m.model_key = s.model_key",
    ),
    "latency_stats": O.with_ctes(
        [
            """r AS (SELECT event_type AS model_key, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)""",
        ],
        """SELECT model_key, n, round(avg(value), 2) AS avg_latency_ms,
  round(max(value) FILTER (i = floor(n * CAST(0.95 AS DOUBLE))), 2) AS p95_latency_ms FROM r GROUP BY model_key, n""",
    ),
}

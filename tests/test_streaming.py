import pytest
from pyspark.sql import functions as F

from reviewlens.operators import evaluate as E
from reviewlens.operators import tfidf
from reviewlens.streaming import reviews as ST

KEY = ["doc_id"]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture
def model(tiny_reviews):
    return tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 1000, (1, 2))


@pytest.fixture
def folder(spark, tiny_reviews, tmp_path):
    """Ten reviews, an empty one, and one that is too long, in several files."""
    odd = spark.createDataFrame([(21, ""), (22, "x" * 5001), (23, "  ")], SCHEMA)
    rows = tiny_reviews.select("doc_id", "text").unionByName(odd)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def stream(spark, folder):
    return ST.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


def scores(spark, folder, model, labels=None):
    path = ST.score_available(spark, stream(spark, folder), KEY, "text", model, 1, 5000, labels)
    return path, ST.read_scores(spark, path, ST.scored_schema(spark.read.parquet(folder), KEY, labels is not None))


def test_stream_equals_batch_and_keeps_rejected_rows(spark, folder, model):
    got = {r["doc_id"]: r for r in scores(spark, folder, model)[1].collect()}
    texts = spark.read.parquet(folder).filter("length(text) BETWEEN 1 AND 5000")
    want = {r["doc_id"]: r["p_pos"] for r in tfidf.score(texts, KEY, "text", model).collect()}
    assert {k: r["p_pos"] for k, r in got.items() if r["status"] == 200} == pytest.approx(want) and 23 in want
    assert {k: (r["status"], r["reason"], r["p_pos"], r["prediction"]) for k, r in got.items() if k in (21, 22)} == {
        21: (422, "too_short", None, None), 22: (422, "too_long", None, None)}


def test_a_stream_is_scored_without_any_broadcast(spark, folder, model, always_shuffle):
    assert scores(spark, folder, model)[1].filter("p_pos IS NOT NULL").count() == 11


def test_restarted_stream_scores_only_new_files(spark, folder, model, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        ST.score_to(stream(spark, folder), KEY, "text", model, 1, 5000, out, checkpoint).awaitTermination()
        return ST.read_scores(spark, out, ST.scored_schema(spark.read.parquet(folder), KEY)).count()

    assert run() == 13
    spark.createDataFrame([(31, "superb")], SCHEMA).write.mode("append").parquet(folder)
    assert run() == 14


def test_a_row_delivered_twice_is_scored_twice(spark, tmp_path, model):
    rows = [(1, "superb cast"), (1, "superb cast"), (1, "tedious"), (None, "dull"), (None, "dull")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = scores(spark, str(tmp_path / "in"), model)[1].collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "None", "None"]
    assert len({r["p_pos"] for r in got if r["doc_id"] == 1}) == 2


def test_a_half_written_batch_is_not_read(spark, folder, model, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = ST.scored_schema(spark.read.parquet(folder), KEY)
    assert ST.read_scores(spark, out, schema).count() == 0
    ST.score_to(stream(spark, folder), KEY, "text", model, 1, 5000, out, checkpoint).awaitTermination()
    good = ST.read_scores(spark, out, schema)
    good.limit(3).write.parquet(f"{out}/data/9-half")  # no log file names it
    assert ST.read_scores(spark, out, schema).count() == 13


def test_a_batch_that_is_run_again_counts_once(spark, folder, model, tmp_path):
    """The stream dies after a batch was named and before its own checkpoint says so."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        ST.score_to(stream(spark, folder), KEY, "text", model, 1, 5000, out, checkpoint).awaitTermination()

    run()
    last = max(int(f.name) for f in (tmp_path / "checkpoint" / "commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).rename(tmp_path / f"gone-{name}")
    run()
    assert ST.read_scores(spark, out, ST.scored_schema(spark.read.parquet(folder), KEY)).count() == 13


def test_streams_with_other_checkpoints_add_to_the_folder(spark, folder, model, tmp_path):
    out = str(tmp_path / "out")
    for name in "ab":
        ST.score_to(stream(spark, folder), KEY, "text", model, 1, 5000, out, str(tmp_path / name)).awaitTermination()
    assert ST.read_scores(spark, out, ST.scored_schema(spark.read.parquet(folder), KEY)).count() == 26


@pytest.fixture
def scored_log(spark, folder, tiny_reviews, model):
    labels = tiny_reviews.select("doc_id", F.col("label").alias("quality"))
    path, rows = scores(spark, folder, model, labels)
    return path, ST.scored_schema(spark.read.parquet(folder), KEY, True)


def test_running_counts_end_in_the_batch_counts(spark, scored_log, tiny_reviews, model, tmp_path):
    path, schema = scored_log
    table = str(tmp_path / "table")
    ST.track_metrics(spark, path, schema, table, str(tmp_path / "checkpoint"), batches_per_trigger=1).awaitTermination()
    got = ST.state_confusion(ST.read_metrics_state(spark, table)).first().asDict()
    batch = E.with_prediction(tfidf.score(tiny_reviews, KEY, "text", model, ["label"]))
    want = E.confusion_counts(batch, []).first().asDict()
    assert {k: got[k] for k in want} == want


def test_metrics_survive_a_restart_and_a_batch_run_again(spark, scored_log, tmp_path):
    path, schema = scored_log
    table, checkpoint = str(tmp_path / "table"), tmp_path / "checkpoint"

    def run():
        ST.track_metrics(spark, path, schema, table, str(checkpoint), batches_per_trigger=1).awaitTermination()
        return sorted(map(tuple, ST.read_metrics_state(spark, table).collect()), key=str)

    first = run()
    assert run() == first  # nothing new
    last = max(int(f.name) for f in (checkpoint / "commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (checkpoint / "commits" / name).rename(tmp_path / f"gone-{name}")
    assert run() == first


def test_running_latency_is_exact(spark):
    state = spark.createDataFrame([("m", 1, 1, float(v), 1 + v % 3) for v in range(40)] + [("n", 0, 1, None, 5)], ST.STATE)
    values = sorted(float(v) for v in range(40) for _ in range(1 + v % 3))
    got = {r["model_key"]: r for r in ST.state_latency(state).collect()}
    assert got["m"]["p95_latency_ms"] == values[int(len(values) * 0.95)]
    assert got["m"]["avg_latency_ms"] == pytest.approx(round(sum(values) / len(values), 2)) and "n" not in got


def test_metrics_of_nothing(spark, tmp_path):
    assert ST.running_report(spark, str(tmp_path / "table")).count() == 0

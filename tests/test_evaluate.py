import math
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import evaluate as E
from reviewlens.operators import report


def counts(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, pred int")
    return E.confusion_counts(df, [])


def metrics(spark, pairs):
    return E.binary_metrics(counts(spark, pairs)).first()


def test_counts_and_metrics(spark):
    m = metrics(spark, [(1, 1)] * 3 + [(0, 1)] + [(0, 0)] * 4 + [(1, 0)] * 2)
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["correct"], m["total"]) == (3, 1, 4, 2, 7, 10)
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.7, 0.75, 0.6, 0.6667)


@pytest.mark.parametrize("pairs,want", [
    ([], (0.0, 0.0, 0.0, 0.0)),
    ([(0, 0)], (1.0, 0.0, 0.0, 0.0)),
    ([(1, 1)], (1.0, 1.0, 1.0, 1.0)),
    ([(1, 0)], (0.0, 0.0, 0.0, 0.0)),
    ([(0, 1)], (0.0, 0.0, 0.0, 0.0)),
])
def test_empty_denominators_are_zero(spark, pairs, want):
    m = metrics(spark, pairs)
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == want


def test_class_report(spark):
    rows = {r["class"]: r for r in E.class_report(
        counts(spark, [(1, 1)] * 3 + [(0, 1)] + [(0, 0)] * 4 + [(1, 0)] * 2), []).collect()}
    assert (rows["negative"]["precision"], rows["negative"]["recall"], rows["negative"]["support"]) == (0.6667, 0.8, 5)
    assert rows["positive"]["f1_score"] == 0.6667
    assert rows["accuracy"]["f1_score"] == 0.7 and rows["accuracy"]["precision"] is None
    assert rows["macro avg"]["recall"] == 0.7 and rows["weighted avg"]["support"] == 10


def test_class_report_of_one_class(spark):
    rows = {r["class"]: r for r in E.class_report(counts(spark, [(0, 0)] * 4), []).collect()}
    assert rows["positive"]["support"] == 0 and rows["positive"]["f1_score"] == 0.0
    assert rows["macro avg"]["f1_score"] == 0.5 and rows["weighted avg"]["f1_score"] == 1.0


def test_matrix_keeps_zero_cells(spark):
    rows = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in E.confusion_matrix(counts(spark, [(1, 1)]), []).collect()}
    assert rows == {0: (0, 0), 1: (0, 1)}


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.25)], "label int, p_pos double")
    row = E.log_loss(df, []).first()
    assert row["loss"] == pytest.approx((-math.log(1e-7) - math.log(0.75)) / 2) and row["accuracy"] == 0.5


def p95(values):
    return round(sorted(values)[int(len(values) * 0.95)], 2)


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_latency_is_an_element_of_the_data(spark, monkeypatch, limit):
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", limit)
    rng = random.Random(7)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "hundred": [float(i) for i in range(100)],
        "equal": [7.0] * 500,
        "ties": [float(rng.randrange(4)) for _ in range(1000)],
        "many": [round(rng.expovariate(0.1), 2) for _ in range(5000)],
        "outlier": [0.5] * 400 + [1e9] * 25,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hundred", None), ("none", None)]
    df = spark.createDataFrame(rows, "model_key string, latency double")
    for accuracy in (10_000, 100):  # all values ranked, and only those in the bracket
        got = {r["model_key"]: r for r in E.latency_stats(df, "model_key", "latency", accuracy).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k]["p95_latency_ms"] == p95(vs), k
            assert got[k]["n"] == len(vs)
            assert got[k]["avg_latency_ms"] == pytest.approx(sum(vs) / len(vs), abs=0.006)


def test_models_are_evaluated_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 1, 0)], "model_key string, label int, pred int")
    counted = E.confusion_counts(df, ["model_key"])
    got = {r["model_key"]: r["accuracy"] for r in E.binary_metrics(counted).collect()}
    assert got == {"a": 0.5, "b": 0.0}
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_benchmark_and_metrics_tables(spark):
    table = spark.createDataFrame([(0, "baseline"), (1, "lstm"), (2, "transformer")], "ord int, model_key string")
    metrics = spark.createDataFrame(
        [("baseline", "Base", 0.8912, 0.5, 0.88, None, 12.34), ("lstm", None, None, 0.8, None, None, None)],
        "model_key string, model string, test_accuracy double, val_accuracy double, test_f1 double, val_f1 double, training_time_seconds double",
    )
    rows = [tuple(r) for r in report.benchmark_table(table, metrics).orderBy("ord").collect()]
    assert rows == [(0, "Base", "89.1%", "0.880", "12.3 s"), (1, "lstm", "80.0%", "-", "-")]
    assert [r["test_accuracy"] for r in report.all_metrics(table, metrics).orderBy("ord").collect()] == [0.8912, None, None]
    summary = report.training_summary(metrics.filter(F.col("model_key") == "lstm")).first()
    assert (summary["measure"], summary["value"]) == ("val_accuracy", 0.8)


def test_a_bracket_beside_the_rank_is_widened(spark, monkeypatch):
    """Whatever the first bracket is, the element is the one at floor(0.95 n)."""
    real = E.bracketed

    def off(timed, by, margin, accuracy):
        return real(timed.withColumn("_v", F.col("_v")), by, margin, 20)

    monkeypatch.setattr(E, "bracketed", off)
    df = spark.range(3000).selectExpr("'m' AS model_key", "CAST(id * 7 % 3000 AS double) AS latency")
    for margin in (1e-6, 0.001):
        assert E.latency_stats(df, "model_key", "latency", margin=margin).first()["p95_latency_ms"] == 2850.0

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import decision as D
from reviewlens.operators import batches, compare, registry, scorers, tfidf, validate
from reviewlens.operators.wordpiece import piece_vocabulary
from reviewlens.operators.vocabulary import fit_word_index

KEY = ["doc_id"]


@pytest.fixture
def model(tiny_reviews):
    return tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 1000, (1, 2))


def test_verdict_and_record(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (0.2,), (0.99996,)], "p double")
    rows = [r["r"] for r in df.select(D.prediction(F.col("p")).alias("r")).collect()]
    assert [r["label"] for r in rows] == ["negative", "positive", "negative", "positive"]
    assert [r["confidence"] for r in rows] == [0.5, 0.5, 0.8, 1.0]
    assert rows[2]["probabilities"].asDict() == {"positive": 0.2, "negative": 0.8}
    assert rows[0]["latency_ms"] == 0.0


def test_softmax_of_known_logits(spark):
    df = spark.createDataFrame([(0.1, 2.5), (2.5, 0.1), (1000.0, 1000.0), (-1000.0, 1000.0)], "a double, b double")
    p = [r[0] for r in df.select(D.softmax2_positive(F.col("a"), F.col("b"))).collect()]
    assert p[0] == pytest.approx(1 / (1 + math.exp(-2.4))) and p[1] == pytest.approx(1 - p[0])
    assert p[2:] == [0.5, 1.0]


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(D.argmax(F.col("v"))).collect()] == [1, 0]


def test_legacy_decision(spark):
    df = spark.createDataFrame([("", 0.9), (None, 0.9), ("x", None), ("x", 0.2), ("x", 0.7)], "t string, p double")
    rows = df.select(D.legacy_verdict(F.col("t"), F.col("p")), D.legacy_confidence(F.col("t"), F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [
        ("neutral", 0.5), ("neutral", 0.5), ("error", 0.0), ("negative", 0.2), ("positive", 0.7)
    ]


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.85,), (0.84,), (0.65,), (0.5,), (0.49,)], "c double")
    rows = df.select(D.confidence_signal(F.col("c")), D.confidence_band(F.col("c"))).collect()
    assert [r[0] for r in rows] == [3, 2, 1 + 1, 1, 0]
    assert [r[1].split()[0] for r in rows] == ["High", "Moderate", "Moderate", "Low", "No"]


def test_shown_figures(spark):
    df = spark.createDataFrame([(0.8125,), (None,), (1.0,)], "x double")
    rows = df.select(D.percent(F.col("x")), D.fixed(F.col("x"), 3, missing="N/A"), D.millis(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [("81.3%", "0.813", "0.8 ms"), ("-", "N/A", "-"), ("100.0%", "1.000", "1.0 ms")]


def test_labels_to_numbers(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("Positive",), (None,)], "s string")
    rows = df.select(D.label_to_int(F.col("s")), D.predicted_int(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 0), (None, 0), (None, 0)]


def test_model_knows_its_reviews(tiny_reviews, model):
    rows = tfidf.score(tiny_reviews, KEY, "text", model, ["label"]).collect()
    assert len(rows) == 10 and all((r["p_pos"] > 0.5) == (r["label"] == 1) for r in rows)


def test_empty_and_unknown_text(spark, model):
    df = spark.createDataFrame([(1, "<br>"), (2, None), (3, "qq zz"), (4, "a b")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["empty"], r["p_pos"]) for r in tfidf.score(df, KEY, "text", model).collect()}
    assert got == {1: (True, 0.5), 2: (True, 0.5), 3: (False, 0.5), 4: (False, 0.5)}


def test_empty_text_ignores_the_intercept(spark, tiny_reviews):
    prior = tfidf.LinearModel("prior", None, 2.0)
    df = spark.createDataFrame([(1, ""), (2, "x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["p_pos"] for r in tfidf.score(df, KEY, "text", prior).collect()}
    assert got[1] == 0.5 and got[2] == pytest.approx(1 / (1 + math.exp(-2)))


def test_models_side_by_side_equal_each_alone(tiny_reviews, model):
    unigrams = tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 20, (1, 1), "uni")
    prior = tfidf.class_prior_model(10, 5)
    wide = {r["doc_id"]: r for r in tfidf.score_models(tiny_reviews, KEY, "text", [model, unigrams, prior]).collect()}
    for m in (model, unigrams, prior):
        for r in tfidf.score(tiny_reviews, KEY, "text", m).collect():
            assert wide[r["doc_id"]][f"p_{m.key}"] == pytest.approx(r["p_pos"])


def test_scores_do_not_depend_on_the_join_strategy(tiny_reviews, model, monkeypatch):
    want = {r["doc_id"]: r["p_pos"] for r in tfidf.score(tiny_reviews, KEY, "text", model).collect()}
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", -1)
    got = {r["doc_id"]: r["p_pos"] for r in tfidf.score(tiny_reviews, KEY, "text", model).collect()}
    assert got == pytest.approx(want)


def test_comparison_and_disagreement(spark):
    wide = spark.createDataFrame([(1, 0.9, 0.8), (2, 0.9, 0.1)], "doc_id bigint, p_a double, p_b double")
    long = compare.to_long(wide, KEY, {"a": "Model A", "b": "Model B"}).orderBy("doc_id", "model_key").collect()
    assert [(r["model_name"], r["verdict"], r["confidence"]) for r in long] == [
        ("Model A", "positive", 0.9), ("Model B", "positive", 0.8),
        ("Model A", "positive", 0.9), ("Model B", "negative", 0.9),
    ]
    apart = {r["doc_id"]: r for r in compare.disagreement(wide, KEY, ["a", "b"]).collect()}
    assert (apart[1]["n_verdicts"], apart[2]["n_verdicts"], apart[2]["spread"]) == (1, 2, 0.8)
    patterns = compare.disagreement_pattern(wide, KEY, ["a", "b"]).collect()
    assert {(r["verdict_a"], r["verdict_b"]): r["n_texts"] for r in patterns} == {
        ("positive", "positive"): 1, ("positive", "negative"): 1
    }


def test_text_limits(spark):
    df = spark.createDataFrame(
        [(1, ""), (2, None), (3, "a" * 5000), (4, "a" * 5001), (5, "   ")], "doc_id bigint, text string"
    )
    checked = validate.validate_texts(df, "text", 1, 5000)
    got = {r["doc_id"]: (r["status"], r["reason"]) for r in checked.collect()}
    assert got == {1: (422, "too_short"), 2: (422, "missing"), 3: (200, "ok"), 4: (422, "too_long"), 5: (200, "ok")}
    assert validate.accepted(checked).count() == 2 and validate.quarantined(checked).count() == 3


def test_batch_limits_of_arrays(spark):
    df = spark.createDataFrame(
        [(1, []), (2, ["x"] * 32), (3, ["x"] * 33), (4, None), (5, ["y" * 5001])], "id int, texts array<string>"
    )
    for strict, last in ((False, 200), (True, 422)):
        checked = validate.validate_batch_arrays(df, "texts", 32, 5000, enforce_item_limit=strict)
        assert {r["id"]: r["status"] for r in checked.collect()} == {1: 422, 2: 200, 3: 422, 4: 422, 5: last}


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_batches_with_one_huge_batch(spark, model, monkeypatch, limit):
    """One batch holds a third of all rows; it is refused, the others are answered in order."""
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", limit)
    rows = [(b, p, "superb cast" if p % 2 else "dull picture") for b in range(1, 31) for p in range(20)]
    rows += [(99, p, "superb cast") for p in range(300)] + [(50, 0, None)]
    df = spark.createDataFrame(rows, "batch bigint, pos bigint, text string")
    got = {r["batch"]: r for r in batches.batch_predict(df, "batch", "pos", "text", model, 32, 5000).collect()}
    assert len(got) == 32
    assert (got[99]["status"], got[99]["count"], got[99]["predictions"]) == (422, None, None)
    assert got[50]["status"] == 422
    labels = [p["label"] for p in got[7]["predictions"]]
    assert got[7]["count"] == 20 and labels == ["negative", "positive"] * 10


def test_requests_with_arrays_become_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "batch bigint, texts array<string>")
    rows = {(r["batch"], r["pos"], r["text"]) for r in batches.explode_requests(df, "batch", "texts").collect()}
    assert rows == {(1, 0, "a"), (1, 1, "b"), (2, None, None)}


def choose(spark, ready, requested, default):
    table = spark.createDataFrame(
        [(i, k, k in ready) for i, k in enumerate(["baseline", "lstm", "transformer"])],
        "ord int, model_key string, available boolean",
    )
    requests = spark.createDataFrame([(requested,)], "requested string")
    row = registry.choose_models(requests, "requested", table, default).first()
    return row["status"], row["model_key"]


@pytest.mark.parametrize("ready,requested,default,want", [
    ({"baseline", "lstm"}, "lstm", "baseline", (200, "lstm")),
    ({"baseline", "lstm"}, "", "lstm", (200, "lstm")),
    ({"baseline", "transformer"}, None, "lstm", (200, "baseline")),
    ({"transformer"}, "", "lstm", (200, "transformer")),
    ({"baseline"}, "transformer", "baseline", (404, None)),
    ({"baseline"}, "nonsense", "baseline", (404, None)),
    (set(), "", "baseline", (503, None)),
    (set(), "lstm", "baseline", (404, None)),
])
def test_model_choice(spark, ready, requested, default, want):
    assert choose(spark, ready, requested, default) == want


class Constant:
    name = "constant"

    def __init__(self):
        self.loaded = False

    def load(self):
        self.loaded = True

    def predict(self, cleaned: pd.Series) -> np.ndarray:
        assert self.loaded and (cleaned != "").all()
        return np.full(len(cleaned), 0.75)


def test_pluggable_scorer(spark):
    df = spark.createDataFrame([(1, "Text!"), (2, "<br>"), (3, None)], "doc_id bigint, text string")
    scored = scorers.with_prediction_record(scorers.score_texts(df, KEY, "text", Constant()))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert [got[i]["p_pos"] for i in (1, 2, 3)] == [0.75, 0.5, 0.5]
    assert got[2]["latency_ms"] == 0.0 and got[1]["prediction"]["label"] == "positive"


@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (2, 2), (1, 3), (2, 3)])
@pytest.mark.parametrize("k", [4, 1000])
def test_batch_scorer_equals_the_relational_score(spark, tiny_reviews, ngram_range, k):
    model = tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", k, ngram_range)
    texts = tiny_reviews.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(91, "superb superb superb cast and superb cast"), (92, "zz yy"), (93, "superb"), (94, "lovely zz lovely")],
        "doc_id bigint, text string",
    )).coalesce(1)
    want = {r["doc_id"]: r["p_pos"] for r in tfidf.score(texts, KEY, "text", model).collect()}
    rows = scorers.score_texts(texts, KEY, "text", scorers.LinearScorer.of(model)).collect()
    assert {r["doc_id"]: r["p_pos"] for r in rows} == pytest.approx(want)


def message(*fields):
    """Encode (number, value) pairs as protocol buffer fields: ints as varints, else bytes."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    parts = []
    for number, value in fields:
        if isinstance(value, int):
            parts.append(varint(number << 3) + varint(value))
        else:
            value = value.encode() if isinstance(value, str) else value
            parts.append(varint(number << 3 | 2) + varint(len(value)) + value)
    return b"".join(parts)


def tiny_onnx_model():
    """logits = (number of real ids) @ [[-1, 0.5]], as an ONNX graph."""
    def tensor_type(name, kind, dims):
        shape = message(*[(1, message((2, d) if isinstance(d, str) else (1, d))) for d in dims])
        return message((1, name), (2, message((1, message((1, kind), (2, shape))))))

    to_float = message((1, "to"), (2 + 1, 1), (20, 2))
    nodes = [
        message((1, "attention_mask"), (2, "m"), (4, "Cast"), (5, to_float)),
        message((1, "m"), (1, "axes"), (2, "n"), (4, "ReduceSum")),
        message((1, "n"), (1, "w"), (2, "logits"), (4, "MatMul")),
    ]
    axes = message((1, 1), (2, 7), (8, "axes"), (9, struct.pack("<q", 1)))
    weight = message((1, 1), (1, 2), (2, 1), (8, "w"), (9, struct.pack("<2f", -1.0, 0.5)))
    graph = message(
        *[(1, n) for n in nodes], (2, "g"), (5, axes), (5, weight),
        (11, tensor_type("input_ids", 7, ["n", "l"])), (11, tensor_type("attention_mask", 7, ["n", "l"])),
        (12, tensor_type("logits", 1, ["n", 2])),
    )
    return message((1, 8), (7, graph), (8, message((2, 13))))


def test_onnx_session_runs_in_the_workers(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "model.onnx"
    path.write_bytes(tiny_onnx_model())
    docs = spark.createDataFrame([(1, "one two"), (2, ""), (3, "one")], "doc_id bigint, text string")
    pieces = piece_vocabulary(fit_word_index(docs, "doc_id", "text", 100))
    scored = scorers.score_logits(docs, KEY, "text", pieces, 16, scorers.onnx_session(str(path)))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert (got[1]["logit_neg"], got[1]["logit_pos"]) == (-4.0, 2.0)
    assert got[1]["p_pos"] == pytest.approx(1 / (1 + math.exp(-6)))
    assert got[2]["p_pos"] == 0.5 and got[3]["logit_neg"] == -3.0


def test_a_scorer_gets_bounded_parts_however_long_the_texts_are(monkeypatch):
    monkeypatch.setattr(scorers, "PART_CHARS", 10)
    texts = pd.Series(["aaaa", "", "bbbb", "cc", "d", "e" * 30, "f", ""])
    parts = [p.tolist() for p in scorers.text_parts(texts)]
    assert parts == [[0, 2, 3], [4], [5], [6]]
    assert scorers.text_parts(pd.Series([""])) == [] and scorers.text_parts(pd.Series([], dtype=object)) == []


def test_parts_change_no_score(spark):
    class Lengths:
        name = "lengths"

        def load(self):
            pass

        def predict(self, cleaned):
            assert cleaned.str.len().sum() <= 1 << 20
            return cleaned.str.len().to_numpy() / 1e6

    docs = spark.range(6).selectExpr("id AS doc_id", "if(id = 3, '', repeat('a', 400000 + cast(id AS int))) AS text").coalesce(1)
    rows = scorers.score_texts(docs, ["doc_id"], "text", Lengths()).collect()
    assert {r["doc_id"]: r["p_pos"] for r in rows} == {i: 0.5 if i == 3 else (400000 + i) / 1e6 for i in range(6)}
    assert all((r["latency_ms"] == 0) == (r["doc_id"] == 3) for r in rows)


def test_few_texts_at_a_time_become_python_strings(monkeypatch):
    """A batch of rows is cut while it is Arrow, before its texts are Python strings."""
    monkeypatch.setattr(scorers, "PART_CHARS", 10)
    texts = ["a" * 4, None, "b" * 6, "", "c" * 30, "d", "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_clean"])
    runs = [r.column("_clean").to_pylist() for r in scorers.text_runs(batch, "_clean")]
    assert runs == [texts[:4], texts[4:5], texts[5:6], texts[6:]]
    assert list(scorers.text_runs(batch.slice(0, 0), "_clean")) == []

import json

import pytest
from pyspark.sql import functions as F

from reviewlens import session
from reviewlens.operators import registry, tfidf
from reviewlens.operators.vocabulary import fit_word_index
from reviewlens.sources import models as M
from reviewlens.sources import reviews as R

KEY = ["doc_id"]


def test_csv_with_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('review,sentiment\n"He said ""no"", twice.\nThen left.",negative\nplain,positive\n" kept ",Mixed\n')
    rows = R.with_int_label(R.read_review_csv(spark, str(tmp_path / "absent.csv"), str(path))).collect()
    assert {(r["review"], r["label"]) for r in rows} == {
        ('He said "no", twice.\nThen left.', 0), ("plain", 1), (" kept ", None)
    }


def test_csv_round_trip(spark, tmp_path):
    texts = ['a "quoted" one', "two\nlines\n", "comma, and ;", "back\\slash", "  edges  ", '""']
    df = spark.createDataFrame([(t, "positive") for t in texts], "review string, sentiment string")
    R.write_review_csv(df, str(tmp_path / "out"))
    back = R.read_review_csv(spark, str(tmp_path / "out"))
    assert sorted(r["review"] for r in back.collect()) == sorted(texts)


def test_empty_csv_cells_are_null(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('review,sentiment\n"",positive\n')
    assert R.read_review_csv(spark, str(path)).first()["review"] is None


def test_missing_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.read_review_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))


def metrics_row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_metrics_are_written_as_json_and_read_back(spark, tmp_path):
    M.save_metrics(metrics_row(spark, model="Base", test_accuracy=0.89, vocab_size=50), f"{tmp_path}/baseline")
    M.save_metrics(metrics_row(spark, model="Seq", val_accuracy=0.8, max_len=5), f"{tmp_path}/lstm")
    M.save_metrics(metrics_row(spark, model="Other", val_accuracy=0.1), f"{tmp_path}/unregistered")
    back = {r["model_key"]: r for r in M.read_metrics(spark, str(tmp_path), registry.registry_table(spark)).collect()}
    assert set(back) == {"baseline", "lstm"}
    assert back["baseline"]["test_accuracy"] == 0.89 and back["baseline"]["max_len"] is None
    assert back["lstm"]["max_len"] == 5
    file = next((tmp_path / "baseline" / "metrics").glob("*.json"))
    assert json.loads(file.read_text()) == {"model": "Base", "test_accuracy": 0.89, "vocab_size": 50}


def test_indented_metrics_beside_the_artefacts(spark, tmp_path):
    """One file is one row, however it is laid out; a report mixes records and a number."""
    report = {"positive": {"precision": 0.5, "recall": 1.0, "f1-score": 0.6, "support": 4}, "accuracy": 0.75}
    (tmp_path / "lstm").mkdir()
    (tmp_path / "lstm" / "metrics.json").write_text(json.dumps(
        {"model": "Seq", "val_accuracy": 0.75, "lstm_units": 64, "dropout_rate": 0.5, "unheard_of": [1], "classification_report": report},
        indent=2))
    M.save_metrics(metrics_row(spark, model="Base", test_accuracy=0.89), f"{tmp_path}/baseline")
    rows = M.read_metrics(spark, str(tmp_path), registry.registry_table(spark)).collect()
    got = {r["model_key"]: r for r in rows}
    assert len(rows) == 2 and got["baseline"]["test_accuracy"] == 0.89 and got["baseline"]["lstm_units"] is None
    assert (got["lstm"]["val_accuracy"], got["lstm"]["lstm_units"], got["lstm"]["dropout_rate"]) == (0.75, 64, 0.5)
    scores = got["lstm"]["classification_report"]
    assert scores["positive"].asDict() == {"precision": 0.5, "recall": 1.0, "f1_score": 0.6, "support": 4}
    assert scores["accuracy"]["f1_score"] == 0.75


def test_a_malformed_metrics_file_fails(spark, tmp_path):
    (tmp_path / "lstm").mkdir()
    (tmp_path / "lstm" / "metrics.json").write_text('{"model": "Seq"')
    with pytest.raises(Exception, match="(?i)malformed"):
        M.read_metrics(spark, str(tmp_path), registry.registry_table(spark)).collect()


def test_sources_without_a_number_are_not_the_test_part(spark):
    df = spark.createDataFrame([("src12",), ("src9",), ("web",), (None,), ("x" + "9" * 30,)], "source string")
    assert [r[0] for r in df.select(R.in_test_part(F.col("source"))).collect()] == [True, False, False, False, True]


def test_saved_length_or_default(spark):
    df = spark.createDataFrame([(5,), (None,)], "max_len int")
    assert [r[0] for r in df.select(M.length_setting(F.col("max_len"), 200)).collect()] == [5, 200]


def test_model_round_trip(spark, tiny_reviews, tmp_path):
    model = tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 1000, (1, 2))
    M.save_linear_model(model, f"{tmp_path}/baseline")
    loaded = M.load_linear_model(spark, f"{tmp_path}/baseline")
    want = {r["doc_id"]: r["p_pos"] for r in tfidf.score(tiny_reviews, KEY, "text", model).collect()}
    got = {r["doc_id"]: r["p_pos"] for r in tfidf.score(tiny_reviews, KEY, "text", loaded).collect()}
    assert got == pytest.approx(want) and loaded.vocab.ngram_range == (1, 2)


def test_word_index_round_trip(spark, tiny_reviews, tmp_path):
    index = fit_word_index(tiny_reviews, "doc_id", "text", 10)
    M.save_word_index(index, str(tmp_path))
    back = M.load_word_index(spark, str(tmp_path), 10)
    assert sorted(map(tuple, back.table.collect())) == sorted(map(tuple, index.table.collect()))


def test_missing_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="train the model first"):
        M.load_linear_model(spark, f"{tmp_path}/nothing")


def test_availability_and_missing_artifacts(spark, tiny_reviews, tmp_path):
    model = tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 1000, (1, 2))
    M.save_linear_model(model, f"{tmp_path}/baseline")
    M.save_word_index(fit_word_index(tiny_reviews, "doc_id", "text", 10), f"{tmp_path}/lstm")
    present = M.list_artifacts(spark, str(tmp_path))
    required = registry.required_artifacts(spark)
    available = registry.availability(registry.registry_table(spark), required, present)
    assert {r["model_key"]: r["available"] for r in available.collect()} == {
        "baseline": True, "lstm": False, "transformer": False
    }
    lists = registry.model_lists(available).first()
    assert lists["models_available"] == ["baseline"]
    assert lists["models_registered"] == ["baseline", "lstm", "transformer"]
    missing = {(r["artifact_dir"], r["artifact"]) for r in registry.missing_artifacts(required, present).collect()}
    assert ("lstm", "network") in missing and ("baseline", "vocabulary") not in missing and len(missing) == 10


def test_shared_folder_is_the_named_one(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    if before:
        assert session.shared_dir(spark) == before.rstrip("/")
    else:
        assert session.shared_dir(spark) == session.shared_dir(spark)


def test_availability_of_many_sites(spark):
    whole = [("a", d, x) for d, x, _ in registry.REQUIRED_ARTIFACTS if d == "baseline"]
    rows = [*whole, *whole, ("b", "baseline", "vocabulary"), ("c", "elsewhere", "notes.txt"), (None, "lstm", "embedding")]
    rows += [("d", d, x) for d, x, essential in registry.REQUIRED_ARTIFACTS if essential]
    present = spark.createDataFrame(rows, "site string, artifact_dir string, artifact string")
    got = registry.availability_by(present, ["site"])
    assert {(r["site"], r["model_key"]) for r in got.collect() if r["available"]} == {
        ("a", "baseline"), ("d", "baseline"), ("d", "lstm"), ("d", "transformer")}
    lists = {r["site"]: (r["models_available"], len(r["models_registered"])) for r in registry.model_lists(got, ["site"]).collect()}
    assert lists == {"a": (["baseline"], 3), "b": ([], 3), "c": ([], 3), None: ([], 3), "d": (["baseline", "lstm", "transformer"], 3)}
    missing = registry.missing_by(present, ["site"]).collect()
    assert sum(r["site"] == "c" for r in missing) == len(registry.REQUIRED_ARTIFACTS)
    assert {(r["artifact_dir"], r["artifact"]) for r in missing if r["site"] == "d"} == {
        (d, x) for d, x, essential in registry.REQUIRED_ARTIFACTS if not essential}

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.operators import report, tfidf
from reviewlens.operators import training as T
from reviewlens.operators.vocabulary import fit_vocabulary
from reviewlens.sources import models as M

CONFIG = JobConfig(embedding_dim=8, hidden_units=4, epochs=6, patience=2)


@pytest.fixture(scope="module")
def reviews(spark):
    good = ["a lovely warm picture", "superb script superb cast", "warm funny lovely", "excellent lovely score", "excellent cast"]
    bad = ["a dull picture", "wooden tedious cast", "tedious dull long", "dreadful score dreadful end", "dreadful wooden acting"]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(10 + i, t, 0) for i, t in enumerate(bad)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


@pytest.fixture(scope="module")
def trained(reviews):
    return T.train_logreg(reviews, "doc_id", "text", "label", CONFIG)


def test_logistic_regression_finds_the_optimum(reviews, trained):
    """The gradient of |w|^2 / 2 + C * sum of losses vanishes, and the intercept is free."""
    vocab = fit_vocabulary(reviews, ["doc_id"], "text", CONFIG.max_features, CONFIG.ngram_range, "label")
    rows = tfidf.vector_table(reviews, ["doc_id"], "text", vocab, ["label"]).collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    w, b = trained.classifier.coefficients.toArray(), trained.classifier.intercept
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(w + x.T @ error).max() < 1e-3 and abs(error.sum()) < 1e-3


def test_scores_equal_the_ml_model(reviews, trained):
    vectors = tfidf.vector_table(reviews, ["doc_id"], "text", trained.model.vocab, ["label"])
    ml = {r["doc_id"]: r["probability"][1] for r in trained.classifier.transform(vectors).collect()}
    ours = {r["doc_id"]: r["p_pos"] for r in tfidf.score(reviews, ["doc_id"], "text", trained.model).collect()}
    assert ours == pytest.approx(ml)


def test_a_fitted_classifier_works_after_an_observation(spark, reviews):
    """Comparing models observes a job, and the session then can't be sent to tasks."""
    fitted = T.train_logreg(reviews, "doc_id", "text", "label", CONFIG)
    seen = Observation()
    reviews.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 10}
    vectors = tfidf.vector_table(reviews, ["doc_id"], "text", fitted.model.vocab, ["label"])
    assert fitted.classifier.transform(vectors).filter("prediction = label").count() >= 8


def test_known_polarity(spark, trained):
    df = spark.createDataFrame([(1, "Superb, lovely!"), (2, "<br>dreadful"), (3, "")], "doc_id bigint, text string")
    p = {r["doc_id"]: r["p_pos"] for r in tfidf.score(df, ["doc_id"], "text", trained.model).collect()}
    assert p[1] > 0.5 > p[2] and p[3] == 0.5


def test_metrics_with_and_without_validation(reviews, trained):
    alone = T.baseline_metrics(trained, {"train": reviews}, "doc_id", "text", "label", CONFIG).first().asDict()
    assert alone["train_accuracy"] >= 0.8 and "val_accuracy" not in alone
    assert alone["vocab_size"] == trained.model.vocab.size and alone["C"] == 1.0
    parts = {"train": reviews, "val": reviews.limit(2), "test": reviews.filter("label = 1")}
    full = T.baseline_metrics(trained, parts, "doc_id", "text", "label", CONFIG).first().asDict()
    assert full["test_f1"] == 1.0 and full["classification_report"]["positive"]["support"] == 5


def test_saved_classifier_predicts_alike(spark, reviews, trained, tmp_path):
    M.save_linear_model(trained.model, str(tmp_path))
    back = M.load_linear_model(spark, str(tmp_path))
    got = {r["doc_id"]: r["p_pos"] for r in tfidf.score(reviews, ["doc_id"], "text", back).collect()}
    assert got == pytest.approx({r["doc_id"]: r["p_pos"] for r in tfidf.score(reviews, ["doc_id"], "text", trained.model).collect()})


def test_embedding_tier_stops_early_and_keeps_the_best(reviews):
    trained = T.train_embedding(reviews, reviews, "doc_id", "text", "label", CONFIG)
    losses = [h[4] for h in trained.history]
    assert trained.best_epoch == losses.index(min(losses)) + 1
    assert len(losses) <= CONFIG.epochs and len(losses) - trained.best_epoch <= CONFIG.patience
    row = T.embedding_metrics(trained, reviews, "doc_id", "text", "label", CONFIG).first()
    assert row["val_loss"] == pytest.approx(min(losses)) and row["epochs_completed"] == len(losses)
    assert T.history_table(trained).count() == len(losses)


def test_saved_embedding_tier_predicts_alike(spark, reviews, tmp_path):
    folder = f"{tmp_path}/lstm"
    trained = T.train_embedding(reviews, reviews, "doc_id", "text", "label", CONFIG)
    M.save_embedding_model(trained, folder)
    back = M.load_embedding_model(spark, folder, CONFIG.num_words)
    want, got = (
        {r["doc_id"]: r["p_pos"] for r in T.score_embedding(reviews, "doc_id", "text", "label", t, CONFIG).collect()}
        for t in (trained, back)
    )
    assert got == pytest.approx(want) and len(got) == 10
    present = {(r["artifact_dir"], r["artifact"]) for r in M.list_artifacts(spark, str(tmp_path)).collect()}
    assert present == {("lstm", "word_index"), ("lstm", "embedding"), ("lstm", "network")}


def test_train_all(reviews):
    splits = reviews.withColumn("split", F.lit("train")).unionByName(
        reviews.limit(4).withColumn("split", F.lit("val"))).unionByName(reviews.limit(3).withColumn("split", F.lit("test")))
    metrics = T.train_targets("all", splits, "doc_id", "text", "label", CONFIG)
    rows = {r["model"]: r["measure"] for r in report.training_summary(metrics).collect()}
    assert rows == {"TF-IDF + Logistic Regression": "test_accuracy", "Embedding + MLP": "val_accuracy"}


def test_unknown_target(reviews):
    with pytest.raises(ValueError):
        T.train_targets("bert", reviews, "doc_id", "text", "label", CONFIG)


def test_a_stopped_fit_goes_on_after_its_last_round(spark, tiny_reviews, tmp_path, monkeypatch):
    config = JobConfig(embedding_dim=4, hidden_units=3, epochs=4, patience=4, epoch_iterations=2, embedding_parts=1, num_words=50)
    train, val = tiny_reviews.filter("doc_id <> 3"), tiny_reviews.filter("doc_id = 3")
    folder = str(tmp_path / "rounds")
    own, fits = T.loss_and_accuracy, []

    def stops(model, data, label):
        fits.append(1)
        if len(fits) == 5:  # in the third round
            raise RuntimeError("stopped")
        return own(model, data, label)

    monkeypatch.setattr(T, "loss_and_accuracy", stops)
    with pytest.raises(RuntimeError):
        T.train_embedding(train, val, "doc_id", "text", "label", config, folder)
    monkeypatch.setattr(T, "loss_and_accuracy", own)
    log = T.RoundLog(spark, folder)
    assert [row[0] for row, _ in log.committed()] == [1, 2]
    resumed = T.train_embedding(train, val, "doc_id", "text", "label", config, folder)
    assert [row[0] for row, _ in log.committed()] == [1, 2, 3, 4]
    again = T.train_embedding(train, val, "doc_id", "text", "label", config, folder)
    assert again.history == resumed.history and again.best_epoch == resumed.best_epoch
    monkeypatch.setattr(T, "fit_word_index", lambda *a: pytest.fail("the base is there"))
    fresh = str(tmp_path / "fresh")
    T.RoundLog(spark, fresh).save_base(resumed.index, resumed.embedding)
    whole = T.train_embedding(train, val, "doc_id", "text", "label", config, fresh)
    assert whole.best_epoch == resumed.best_epoch
    for one, other in zip(whole.history, resumed.history):
        assert one == pytest.approx(other, abs=1e-6)

import json

import pytest

from reviewlens.operators import registry, tfidf
from reviewlens.sources import models as M
from reviewlens.sources import published as P

KEY = ["doc_id"]


@pytest.fixture
def model(tiny_reviews):
    return tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 100, (1, 2), "baseline")


def test_a_file_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/log/0.json"
    assert P.read_file(spark, path) is None
    assert P.write_once(spark, path, "first") and not P.write_once(spark, path, "second")
    assert P.read_file(spark, path) == "first"
    P.replace_file(spark, path, "third \u00e9")
    assert P.read_file(spark, path) == "third \u00e9"
    assert [f.name for f in (tmp_path / "log").iterdir() if not f.name.endswith(".crc")] == ["0.json"]


def test_of_two_writers_that_both_saw_nothing_one_wins(spark, tmp_path):
    path = f"{tmp_path}/log/0.json"
    P._move_in(spark, path, "first", "NONE")
    with pytest.raises(Exception, match="FileAlreadyExists"):
        P._move_in(spark, path, "second", "NONE")
    assert P.read_file(spark, path) == "first"


def test_a_version_that_was_not_finished_is_not_seen(spark, tmp_path, model):
    folder = f"{tmp_path}/baseline"
    M.save_linear_model(model, folder)
    before = P.current(spark, folder)
    with pytest.raises(RuntimeError), P.new_version(spark, folder) as path:
        spark.range(3).write.parquet(f"{path}/vocabulary")
        raise RuntimeError("stopped half way")
    assert P.current(spark, folder) == before
    loaded = M.load_linear_model(spark, folder)
    assert loaded.vocab.size == model.vocab.size and loaded.vocab.path == model.vocab.path
    present = {tuple(r) for r in M.list_artifacts(spark, str(tmp_path)).collect()}
    assert present == {("baseline", "vocabulary"), ("baseline", "classifier")}


def test_only_published_artifacts_make_a_model_available(spark, tmp_path, model):
    with pytest.raises(RuntimeError), P.new_version(spark, f"{tmp_path}/baseline") as path:
        for name in ("vocabulary", "classifier"):
            spark.range(1).write.parquet(f"{path}/{name}")
        raise RuntimeError("stopped before it was published")

    def available():
        there = registry.availability(
            registry.registry_table(spark), registry.required_artifacts(spark), M.list_artifacts(spark, str(tmp_path)))
        return {r["model_key"] for r in there.collect() if r["available"]}

    with pytest.raises(FileNotFoundError):
        M.load_linear_model(spark, f"{tmp_path}/baseline")
    M.save_linear_model(model, f"{tmp_path}/baseline")
    assert available() == {"baseline"}


def test_metrics_come_with_their_version(spark, tmp_path, model):
    table = registry.registry_table(spark)
    for accuracy in (0.5, 0.75):
        row = spark.createDataFrame([("TF-IDF", accuracy)], "model string, test_accuracy double")
        M.save_linear_model(model, f"{tmp_path}/baseline", row)
        assert [r["test_accuracy"] for r in M.read_metrics(spark, str(tmp_path), table).collect()] == [accuracy]


def test_versions_before_the_last_two_are_removed(spark, tmp_path):
    names = []
    for i in range(4):
        with P.new_version(spark, str(tmp_path), number=i) as path:
            spark.range(i).write.parquet(path)
        names.append(path.rsplit("/", 1)[1])
    assert {f.name for f in (tmp_path / "versions").iterdir()} == set(names[-2:])
    assert P.manifest(spark, str(tmp_path))["number"] == 3
    assert json.loads((tmp_path / "manifest.json").read_text())["version"] == names[-1]

"""The shared folder and the part count of spread tables."""

from types import SimpleNamespace

import pytest

from reviewlens import session


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d)))


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id", "repeat(cast(id AS string), 50) AS text").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.spread(table, ["id"]).rdd.getNumPartitions() == least
    monkeypatch.setattr(session, "SPREAD_BYTES", session.input_bytes(table) // 40)
    assert session.spread(table, ["id"]).rdd.getNumPartitions() >= 40

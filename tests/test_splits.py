import hashlib

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import splits


def ranked(rows, seed):
    """Brute force: the rank of every key inside its class."""
    by_class = {}
    for key, label in rows:
        by_class.setdefault(label, []).append((hashlib.md5(f"{seed}-{key}".encode()).hexdigest(), key))
    return {
        key: (i + 1, len(members), label)
        for label, members in by_class.items() for i, (_, key) in enumerate(sorted(members))
    }


def labelled(spark, n_pos, n_neg):
    rows = [(i, 1) for i in range(n_pos)] + [(i, 0) for i in range(n_pos, n_pos + n_neg)]
    return rows, spark.createDataFrame([(k, f"review {k}", v) for k, v in rows], "doc_id bigint, text string, label int")


@pytest.mark.parametrize("n_pos,n_neg", [(20, 20), (341, 58), (5, 0), (1, 1), (3, 1000)])
def test_train_val_equals_plain_ranking(spark, n_pos, n_neg):
    rows, docs = labelled(spark, n_pos, n_neg)
    got = {r["doc_id"]: r["split"] for r in splits.train_val_split(docs, "doc_id", "label", 0.1, 42).collect()}
    want = {k: "val" if rank <= int(n * 0.1 + 0.5) else "train" for k, (rank, n, _) in ranked(rows, 42).items()}
    assert got == want


def test_split_is_exact_and_keeps_proportions(spark):
    docs = spark.range(25_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 2).cast("int").alias("label")
    )
    got = {r["split"]: r for r in splits.split_summary(
        splits.train_val_split(docs, "doc_id", "label", 0.1, 42), "label").collect()}
    assert (got["train"]["n"], got["val"]["n"]) == (22_500, 2_500)
    assert got["train"]["pos"] == 11_250 and got["val"]["neg"] == 1_250


def test_three_way(spark):
    rows, docs = labelled(spark, 50, 37)
    got = {r["doc_id"]: r["split"] for r in splits.three_way_split(docs, "doc_id", "label", 0.2, 0.5, 42).collect()}
    want = {
        k: "train" if rank <= n * 8 // 10 else "val" if rank <= n * 9 // 10 else "test"
        for k, (rank, n, _) in ranked(rows, 42).items()
    }
    assert got == want


def test_seed_changes_the_members(spark):
    _, docs = labelled(spark, 100, 100)
    a, b = (
        {r["doc_id"] for r in splits.train_val_split(docs, "doc_id", "label", 0.1, s).filter("split = 'val'").collect()}
        for s in (1, 2)
    )
    assert a != b and len(a) == len(b) == 20


def test_one_class_with_most_rows_without_broadcast(spark, always_shuffle):
    rows, docs = labelled(spark, 2000, 10)
    got = {r["doc_id"]: r["split"] for r in splits.train_val_split(docs, "doc_id", "label", 0.1, 42).collect()}
    assert got == {k: "val" if rank <= int(n * 0.1 + 0.5) else "train" for k, (rank, n, _) in ranked(rows, 42).items()}


def test_predefined_test_part_is_untouched(spark):
    _, docs = labelled(spark, 40, 40)
    got = splits.predefined_split(docs, F.col("doc_id") >= 60, "doc_id", "label", 0.1, 42)
    test = {r["doc_id"] for r in got.filter("split = 'test'").collect()}
    assert test == set(range(60, 80)) and got.count() == 80


def test_text_is_not_shuffled_by_a_split(spark):
    _, docs = labelled(spark, 20, 20)
    plan = splits.train_val_split(docs, "doc_id", "label", 0.1, 42)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_pairing_check(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 0), ("c", None)], "text string, label int")
    row = splits.pairing_check(docs, "text", "label").first()
    assert (row["n_texts"], row["n_labels"], row["n_unpaired"], row["n_bad_labels"], row["paired"]) == (3, 3, 2, 1, False)

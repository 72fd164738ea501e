"""Exact top-k against scoring everything."""

from __future__ import annotations

import math
import random

import pytest

from reviewlens.llm.topk import TopKConfig, top_k


def brute(rows, k, every):
    """Every row but the query's own is a candidate, rows that repeat an id included."""
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, w) in enumerate(rows):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), c) for n, (c, v) in enumerate(rows) if n != q)[:k]
            out += [(i, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("config", [
    TopKConfig(), TopKConfig(k=5, every=3, block_rows=4, group_rows=16, batch_queries=2), TopKConfig(k=500, every=7, group_rows=50)])
def test_like_brute_force(spark, config):
    random.seed(5)
    rows = [(i * 2 - 30, [random.choice([-1.0, -0.25, 0.0, 0.5, random.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(400 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(900, None), (902, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] + [0.0] * 5), (906, [float("inf")] + [0.0] * 5)]
    rows += [(None, [0.0] * 6), rows[5], (rows[6][0], [9.0] * 6), (840, [2.0, 1.0]), (841, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, query_id string")
    got = sorted(map(tuple, top_k(frame.repartition(3), config).collect()))
    assert got == brute(rows, config.k, config.every)


def test_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert top_k(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in top_k(spark.createDataFrame([(20, [1.0]), (3, [-0.01])], schema)).collect()] == [(20, 1, 3, -64)]


def test_the_better_of_rows_that_repeat_an_id_counts(spark):
    frame = spark.createDataFrame([(20, [1.0]), (3, [1.0]), (3, [2.0]), (20, [-1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, top_k(frame, TopKConfig(k=2)).collect()))
    assert got == [(20, 1, 3, -4096), (20, 1, 3, 8192), (20, 2, 3, 4096), (20, 2, 20, -4096)]


def test_one_far_id_makes_no_large_group(spark):
    rows = [(i, [math.sin(i), math.cos(i)]) for i in range(600)] + [(10**12, [1.0, 1.0])]
    config = TopKConfig(k=3, every=50, block_rows=8, group_rows=64, batch_queries=5)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, top_k(frame, config).collect())) == brute(rows, 3, 50)

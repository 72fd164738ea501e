"""Hard negatives against scoring everything."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from reviewlens.llm import negatives as N

SMALL = N.MiningConfig(every=5, block_rows=16, batch_anchors=4, sample_rows=40, step=4)


def usable(row):
    key, vector, label = row[:3]
    return key is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute(rows, config):
    rows = [(key, [math.floor(config.scale * x) for x in v], label) for key, v, label in filter(usable, (r[:3] for r in rows))]
    out = []
    for a, (anchor, w, label) in enumerate(rows):
        if anchor % config.every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(w, v)), key, other == label)
                        for c, (key, v, other) in enumerate(rows) if c != a)
        positives = [(key, -s) for s, key, same in scored if same][:config.positives]
        for positive, top in positives:
            fits = [(key, -s) for s, key, same in scored if not same and config.low * top <= -100 * s <= config.high * top]
            out += [(anchor, positive, n + 1, key, top, s) for n, (key, s) in enumerate(fits[:config.negatives])]
    return sorted(out)


def table(n=240, dims=6, seed=4):
    random.seed(seed)
    middles = [[random.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        middle = random.choice(middles)
        rows.append((i - 20, [x + random.choice([0.0, 0.25, random.gauss(0, 0.3)]) for x in middle], random.randrange(3)))
    rows += [(500 + i, rows[30][1], i % 3) for i in range(25)]  # ties
    rows += [(700, None, 1), (705, [None] + [0.1] * 5, 1), (710, [float("nan")] + [0.0] * 5, 1), (715, [0.3] * 6, None),
             (None, [0.2] * 6, 1), (720, [0.0] * 6, 1), (725, [0.4, 0.2], 2), (730, [], 0), (rows[25][0], [0.9] * 6, 1), rows[25],
             (735, [-9.0] * 6, 77), (740, [float("inf")] * 6, 1)]
    return rows


@pytest.mark.parametrize("config", [
    N.MiningConfig(every=5), SMALL, N.MiningConfig(every=7, block_rows=50, batch_anchors=9, positives=2, negatives=30, low=0, high=100)])
def test_like_brute_force(spark, config):
    rows = table()
    frame = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows],
                                  "vec_id bigint, embedding array<double>, label int, row int, norm double, block string")
    got = sorted(map(tuple, N.mine(frame.repartition(5), config).collect()))
    assert got == brute(rows, config) and got


def test_far_apart_values_stay_exact(spark):
    rows = [(i, [1e6 * math.sin(i * j + 1) for j in range(4)], i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, N.mine(frame, SMALL).collect())) == brute(rows, SMALL)


def test_a_walk_stops_once_the_bound_is_below_the_floor():
    rng = np.random.default_rng(0)
    matrix = np.concatenate([rng.normal(0, 20, (2000, 8)) + 300 * np.eye(8)[0], rng.normal(0, 20, (2000, 8)) - 300 * np.eye(8)[0]]
                            ).astype(np.int64)
    anchors = matrix[:10]
    centre = N.fit_centres(anchors, 1)[0]
    spread = float(N.angles(N.directions(anchors)[1], centre[None, :]).max())
    ids = np.arange(len(matrix))
    shared = N.SharedList(ids, ids, np.zeros(len(matrix), int), matrix, centre, spread)
    low, high = np.full((10, 1), N.LEAST), np.full((10, 1), -N.LEAST)
    found, scored = shared.walk(anchors, ids[:10], np.zeros(10, int), low, high, 5, True, 64)
    assert scored < 0.55 * anchors.shape[0] * len(matrix)
    scores = anchors @ matrix.T
    for a in range(10):
        want = sorted((-int(scores[a, i]), int(i)) for i in ids if i != a)[:5]
        assert sorted((-s, i) for b, _, i, _, s in found if b == a) == want


def test_blocks_out_of_reach_do_not_travel(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.02, 8) + np.eye(8)[i % 8]).tolist(), i % 8) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint").withColumnRenamed("embedding", "e")
    vectors = frame.select("vec_id", "label", N.weights(N.F.col("e"), 256).alias("w"))
    index = N.Index(vectors, N.MiningConfig(every=8, block_rows=50, batch_anchors=20))
    asked = index.anchors.withColumns({"low": N.F.array(N.F.lit(60_000)), "high": N.F.array(N.F.lit(-N.LEAST))})
    n_batches = asked.select("batch").distinct().count()
    assert 0 < index.pairs(asked).count() <= n_batches * index.n_blocks / 2


def test_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert N.mine(spark.createDataFrame([], schema)).count() == 0
    assert N.mine(spark.createDataFrame([(50, [1.0], 1)], schema)).count() == 0
    assert N.mine(spark.createDataFrame([(3, [1.0], 1), (4, [1.0], 1)], schema)).count() == 0
    rows = [(50, [1.0], 1), (2, [1.0], 1), (3, [0.75], 2), (4, [0.75], 2), (5, [0.96], 2), (6, [0.25], 2)]
    got = sorted(map(tuple, N.mine(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(50, 2, 1, 3, 65536, 49152), (50, 2, 2, 4, 65536, 49152)]

"""Near-duplicates against comparing all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm.graph import smallest_linked
from reviewlens.llm.minhash import (
    MinHashConfig, compare_batches, near_duplicates, shingle_sets, signature, without_near_duplicates,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = []
    for i, s in sets:
        c = None if i is None else find(i)
        out.append((i, len(s), c, None if i is None else c == i))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def near_rows(seed):
    """Groups of edited copies around the threshold, where stars alone miss links."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(random.choice([3, 12, 60, 200]))]
        for _ in range(random.choice([1, 2, 9])):
            own = list(base)
            for _ in range(random.randrange(0, 1 + len(own) // 9)):
                own[random.randrange(len(own))] = word()
            rows.append((i, random.choice([" ", "\t", "\n"]).join(own)))
            i += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, config", [
    (1, MinHashConfig(width=2)), (2, MinHashConfig()), (3, MinHashConfig(width=2, block_rows=2, prints=8, margin=0.4, broadcast_bytes=0))])
def test_like_brute_force(spark, seed, config):
    rows = near_rows(seed)
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "ÄB"), (906, "äb"), (907, rows[0][1])]
    rows += [(908, "x y z " * 300), (None, rows[1][1]), rows[2], (rows[3][0], rows[4][1])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, component_id int").repartition(3)
    got = sorted(map(tuple, near_duplicates(docs, config).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == brute(rows, config.width)


def test_empty_table_and_filter(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(4, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (3, "other", "z"), (None, "a b c d e f g", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (True, 0)]


def test_signature_agrees_with_similarity():
    """Bins of sparse and dense sets agree about as often as the sets are similar."""
    random.seed(8)
    for n in (4, 40, 2000):
        texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(n))]
        words = texts[0].split()
        words[: n // 4] = [f"v{i}" for i in range(n // 4)]
        texts.append(" ".join(words))
        a, b = shingle_sets(pa.array(texts), 1)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signature(a, 392) == signature(b, 392)).mean() - truth) < 0.12


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["node"]: r["root"] for r in smallest_linked(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_sampled_prints_keep_pairs_at_the_bound():
    # Of a union of 280 sampled shingles 193 are shared: 4.6 standard deviations below a similarity of 0.8.
    values = np.arange(280, dtype=np.uint32) * np.uint32(7)
    prints = [values[:236].tobytes(), np.concatenate((values[:193], values[236:])).tobytes()]
    batch = pa.RecordBatch.from_pydict({
        "band": [1, 1], "i": [0, 0], "j": [0, 0], "side": [0, 1], "id": [1, 2], "n_shingles": [1000, 1000], "root": [1, 2],
        "outer": [True, False], "level": pa.array([1, 1], pa.int32()), "prints": prints})
    found = [row for out in compare_batches(MinHashConfig())([batch]) for row in out.to_pylist()]
    assert found == [{"u": 1, "v": 2}]


def test_edited_copies_of_long_texts(spark):
    random.seed(5)
    rows, words = [], [f"w{random.randrange(20_000)}" for _ in range(3000)]
    for i in range(14):  # each is close to the one before it, the ends of the chain are not alike
        rows.append((i, " ".join(words)))
        for _ in range(64 + i):
            words[random.randrange(len(words))] = f"n{random.randrange(10**6)}"
    got = near_duplicates(spark.createDataFrame(random.sample(rows, len(rows)), "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)

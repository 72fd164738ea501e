"""Substring dedup against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from reviewlens.llm.repeats import RepeatConfig, remove_repeats, run_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i: i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i: i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows_with_repeats():
    random.seed(3)
    word = lambda: random.choice("a b c dd ée fff ß g h".split())
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(random.randrange(0, 60))]
        at = random.randrange(len(own) + 1)
        if i % 3 == 0:
            own[at:at] = passage[random.randrange(5): 30 - random.randrange(5)]
        rows.append((i, random.choice([" ", "\n", " \t"]).join(own)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x " * 40), (104, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(105, rows[0][1]), (105, rows[0][1])]
    return rows


@pytest.mark.parametrize("config", [
    RepeatConfig(length=6, prefix=3),
    RepeatConfig(length=6, prefix=3, group_runs=3, tree_bytes=200),
    RepeatConfig(length=6, prefix=6, group_runs=1),
    RepeatConfig(length=5, prefix=1, broadcast_keys=0, tree_bytes=1),
    RepeatConfig(length=35, prefix=18),
])
def test_like_brute_force(spark, config):
    rows = rows_with_repeats()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = remove_repeats(docs, config, digest=True)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, config.length), key=key)


def test_texts_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, "p  q r s t", 5), (2, "a\nb c q r s", 6), (3, "one  two", 7), (4, None, 8)],
        "doc_id bigint, text string, n_words int").withColumnRenamed("n_words", "kept")
    got = {r["doc_id"]: r for r in remove_repeats(docs, RepeatConfig(length=3, prefix=2), others=True).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == ["p t", "a b c", "one  two", None]
    assert got[3]["others"]["kept"] == 7 and got[2]["n_removed"] == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(empty, RepeatConfig()).count() == 0


def test_runs_need_little_memory_beside_their_text():
    """Runs overlap; cutting out their text must not take an index of eight bytes for each of its bytes."""
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(400)) for _ in range(460)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = run_batches(RepeatConfig())
    expected = sum(part.num_rows for part in run([batch]))  # tables that are kept are made here
    tracemalloc.start()
    found = sum(part.num_rows for part in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == expected > 10_000
    assert peak < 15 * sum(map(len, texts))

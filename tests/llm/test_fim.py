"""Fill-in-the-middle against cuts written down plainly."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import fim


def plainly(key, text, unit=None):
    text = text or ""
    units = list(text) if unit is None else re.findall(unit, text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def order(row):
    return tuple(map(str, row))


def test_every_rank_is_reached():
    random.seed(1)
    for n in (0, 1, 2, 7, 8, 9, 64, 500, 5000):
        widths = np.array([random.randint(0, 9) for _ in range(n)], np.int64)
        index = fim.SkipList(widths)
        sums = np.concatenate(([0], np.cumsum(widths))).tolist()
        ranks = range(n + 1) if n <= 500 else random.sample(range(n + 1), 300)
        assert all(index.place(r) == sums[r] for r in ranks)
        with pytest.raises(IndexError):
            index.place(n + 1)


def test_high_lanes_skip_most_units():
    index = fim.SkipList(np.ones(100_000, np.int64))
    sizes = [len(units) for units, _ in index.links]
    assert len(sizes) >= 5 and all(a > 5 * b for a, b in zip(sizes, sizes[1:]) if b > 50)
    assert all(units.sum() == 100_000 and points.sum() == 100_000 for units, points in index.links)


TEXTS = [
    None, "", "a", "ab", "äß€\U0001F600" * 50, "x" * 20_000, "has <M> in it", "<P", "<", "ends with <S", "S>starts", "two\nlines <",
    "<<<>>>" * 9, "é" * 30,
]


def test_documents_like_plain_cuts(spark):
    rows = [(i, text, "x", 1) for i in range(12) for text in TEXTS] + [(None, "no key", "x", 1), (3, "ab", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    cut = fim.fill_in_middle(frame.repartition(4))
    got = cut.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [plainly(key, text) for key, text, *_ in rows]
    assert sorted([tuple(r)[:6] for r in got], key=order) == sorted(want, key=order)
    texts = sorted((str(key), text or "") for key, text, *_ in rows)
    assert sorted((str(r["doc_id"]), r["back"]) for r in got) == texts
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_units(spark):
    pattern = r"\S+\s*"
    rows = [(i, " ".join(f"wort{j}ä" for j in range(i * 3))) for i in range(1, 30)] + [(99, "   ")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fim.fill_in_middle(frame, fim.FimConfig(unit=pattern)).collect()
    want = [plainly(key, text, pattern) for key, text in rows[:-1]]
    assert sorted([tuple(r) for r in got if r["doc_id"] != 99], key=order) == sorted(want, key=order)
    assert [r["n"] for r in got if r["doc_id"] == 99] == [1]
    assert fim.unit_widths("  a b", re.compile(r"\S+")).tolist() == [4, 1]


def test_an_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

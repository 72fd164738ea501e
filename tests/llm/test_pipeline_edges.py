"""The pipeline's stages on odd tables, and every query without SQL has a test of its own."""

from __future__ import annotations

import pathlib
import random
import re

import pytest

import corpus_pipeline
from reviewlens.llm import packing, queries
from reviewlens.session import scratch_path

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, component_id bigint, n_tokens string, "
          "bin_id string, spans string, rejected int, others string, digest string, `dotted.name` int, row int")


def rows():
    random.seed(12)
    words = [f"wort{i}" for i in range(300)]
    out = []
    for i in range(40):
        text = " ".join(random.choices(words, k=random.randint(1, 80)))
        out.append((i, text, "en", "s"))
    passage = " ".join(random.choices(words, k=60))
    out += [(100 + i, f"{' '.join(random.choices(words, k=30))} {passage} end {i}", "de", "t") for i in range(3)]
    out += [(200, None, None, None), (None, "no key at all but some words", None, "s"), (None, "no key at all but some words", "en", None),
            (201, "", "en", "s"), (202, " \n\t", "en", "s"), (203, "x" * 200_000, "en", "s"), (204, " ".join(words * 40), "en", "s"),
            (1, out[1][1], "en", "s"), (1, "another text under the same number", "en", "s"), (205, "token=abcdef12345", "en", "s")]
    return [(*r, 7, None, 3, "n", "b", "s", 1, "o", "d", 5, 6) for r in out]


@pytest.mark.parametrize("name", ["odd", "empty", "no text", "no labels"])
def test_stages_on_odd_tables(spark, name):
    folder = scratch_path(spark, "edges")
    data = {"odd": rows(), "empty": [], "no text": [(i, None, *r[2:]) for i, r in enumerate(rows())], "no labels": rows()}[name]
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [] if name in ("empty", "no labels") else [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, 0), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage, function in corpus_pipeline.STAGES:
        path = scratch_path(spark, "edges-stage")
        function(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        if stage != "packing":
            assert after.columns == docs.columns
            ids = {r["doc_id"] for r in docs.collect()}
            assert {r["doc_id"] for r in after.collect()} <= ids and after.count() <= docs.count()
        else:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = after
    assert (docs.count() > 0) == (name != "empty")


# Queries that SQL can't express, with the test that compares them with a plain way.
PLAIN_TESTS = {
    "op3_secrets": "test_narrow.py::test_secrets_like_plain_expressions",
    "op4_language_id": "test_narrow.py::test_language_network",
    "op5_piece_codec": "test_narrow.py::test_pieces_like_the_library",
    "op6_best_fit_packing": "test_grouped.py::test_packing_next_to_all_packings",
    "op7_order_minhash": "test_grouped.py::test_order_fingerprints",
    "op10_toxicity_chain": "test_narrow.py::test_toxicity_chain",
    "op13_word_bpe": "test_wordbpe.py::test_the_query_on_all_documents",
}


def test_every_query_is_held_against_something():
    assert set(queries.QUERIES) == set(queries.ORACLES) | set(PLAIN_TESTS)
    here = pathlib.Path(__file__).parent
    for name in PLAIN_TESTS.values():
        file, function = name.split("::")
        assert re.search(rf"^def {function}\(", (here / file).read_text(), re.M)


def test_words_are_packed_by_one_worker_a_task(spark):
    """Cutting and packing run in one Python pass, with the rows that the two of them give one after the other."""
    rows = [(i, " ".join(f"w{j}" for j in range(n)) if n else None) for i, n in enumerate((0, 5, 700, 4096, 9000, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    once = packing.pack_words(docs)
    twice = packing.pack(packing.word_parts(docs), parts="parts")
    assert once.schema == twice.schema
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    staged = corpus_pipeline.pack_sequences(spark, docs, "")
    assert staged._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1

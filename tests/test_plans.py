"""The plans that matter at size: where rows move, what is read, and where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.tokens import CLEANED
from reviewlens.operators import sequences, tfidf
from reviewlens.operators.vocabulary import TermSketch, count_terms, fit_vocabulary, fit_word_index
from reviewlens.plans import catalog
from reviewlens.session import input_bytes
from reviewlens.sources import reviews as R

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan(df))


@pytest.fixture(scope="module")
def docs(spark):
    return R.read_documents(spark, SF).withColumn("label", (F.col("doc_id") % 2).cast("int"))


@pytest.fixture(scope="module")
def model(docs):
    return tfidf.class_log_odds_model(docs, ["doc_id"], "text", "label", 500, (1, 2))


def test_scoring_moves_the_texts_once_and_nothing_else(docs, model):
    scored = tfidf.score(docs, ["doc_id"], "text", model)
    assert exchanges(scored) == ["hashpartitioning"]
    assert "BroadcastHashJoin" in plan(scored) and "Python" not in plan(scored)


def test_more_models_do_not_mean_more_passes(docs, model):
    other = tfidf.class_log_odds_model(docs, ["doc_id"], "text", "label", 500, (1, 1), "uni")
    assert exchanges(tfidf.score_models(docs, ["doc_id"], "text", [model, other])) == ["hashpartitioning"]


def test_without_broadcast_hot_terms_are_salted(docs, model, always_shuffle):
    assert "_salt" in plan(tfidf.score(docs, ["doc_id"], "text", model))


def test_weights_and_vectors_move_the_texts_once(docs):
    vocab = fit_vocabulary(docs, ["doc_id"], "text", 500, (1, 2))
    for df in (
        tfidf.tfidf_weights(docs, ["doc_id"], "text", vocab),
        tfidf.sparse_vectors(docs, ["doc_id"], "text", vocab),
    ):
        assert exchanges(df) == ["hashpartitioning"] and "Python" not in plan(df)


def test_terms_are_matched_before_they_are_counted(docs, model):
    """No string is counted per text: aggregates are keyed by the number of a term."""
    vocab = fit_vocabulary(docs, ["doc_id"], "text", 500, (1, 2))
    for df in (tfidf.score(docs, ["doc_id"], "text", model), tfidf.tfidf_weights(docs, ["doc_id"], "text", vocab)):
        keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", plan(df))
        assert any("term_id#" in k for k in keys) and not any("term#" in k for k in keys)


def test_weights_of_a_text_are_not_gathered_in_one_row(docs):
    text = plan(tfidf.tfidf_weights(docs, ["doc_id"], "text", fit_vocabulary(docs, ["doc_id"], "text", 500, (1, 2))))
    assert "collect_list" not in text and "Window" in text


def test_fitting_does_not_count_per_text(docs):
    counted = count_terms(docs, "text", [(500, (1, 2))], "label", TermSketch(), CLEANED)
    assert set(re.findall(r"Aggregate\(keys=\[([^\]]*?)#\d+\]", plan(counted))) == {"term"}


def test_sequences_move_the_texts_once(docs):
    index = fit_word_index(docs, "doc_id", "text", 100)
    assert exchanges(sequences.text_sequences(docs, "doc_id", "text", index)) == ["hashpartitioning"]


def test_no_text_is_carried_past_an_explode(docs, model):
    generate = next(line for line in plan(tfidf.score(docs, ["doc_id"], "text", model)).splitlines() if "Generate" in line)
    kept = re.search(r"\[([^\]]*)\], (true|false), \[term", generate).group(1)
    assert "_clean" not in kept and "text" not in kept


def test_the_oldest_verdict_carries_no_text_past_an_explode(spark):
    text = plan(catalog.QUERIES["legacy_decide"](spark, SF))
    generate = next(line for line in text.splitlines() if "Generate" in line)
    kept = re.search(r"\[([^\]]*)\], (true|false), \[term", generate).group(1)
    assert "text" not in kept and "head" in kept


@pytest.mark.parametrize("name", ["clean_pages", "clean_steps", "clean_conversations", "legacy_normalise", "tokens"])
def test_cleaning_is_a_narrow_codegen_job(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in text and "Exchange hash" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(catalog.QUERIES["clean_pages"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_sequences_look_words_up_without_a_row_per_word(docs):
    """A broadcast index is looked up text by text: no word is exploded and nothing is grouped."""
    index = fit_word_index(docs, "doc_id", "text", 50)
    plan = sequences.text_sequences(docs, "doc_id", "text", index)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_vectors_are_sorted_without_a_comparing_function(docs):
    vectors = tfidf.sparse_vectors(docs, ["doc_id"], "text", fit_vocabulary(docs, ["doc_id"], "text", 500, (1, 2)))
    text = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in text and "array_sort(" not in text


def test_texts_that_are_counted_one_by_one_lie_in_smaller_parts(docs, model, monkeypatch):
    """A task holds every known term of its documents, so its part is smaller than one whose terms are summed."""
    parts = lambda df: sorted(map(int, re.findall(r"Exchange hashpartitioning\(_spot#\d+L?, (\d+)\)", plan(df))))
    monkeypatch.setattr("reviewlens.operators.vocabulary.COUNTED_BYTES", input_bytes(docs) // 60)
    assert parts(tfidf.score(docs, ["doc_id"], "text", model))[0] >= 60
    assert parts(count_terms(docs, "text", [(500, (1, 2))], "label", TermSketch(), CLEANED))[0] < 60

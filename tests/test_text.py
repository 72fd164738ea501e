import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text as X
from reviewlens.functions.tokens import legacy_tokens, ngram_terms, raw_word_tokens, word_tokens

CASES = [
    ("Lovely.<br />Watch it", "lovely watch it"),
    ("One<br /><br />Two", "one two"),
    ("<p>Fine <b>cast</b></p>", "fine cast"),
    ('<a href="http://site.example/x">link</a>', "link"),
    ("<i\nclass='x'>split tag</i>", "split tag"),
    ("salt &amp; pepper", "salt pepper"),
    ("1 &lt; 2 &gt; 0", "1 2 0"),
    ("it&#39;s", "it s"),
    ("hex &#x27; stays", "hex x27 stays"),
    ("open &copy entity", "open copy entity"),
    ("5 < 10 and 20 > 3", "5 3"),
    ("read http://site.example/a?b=c now", "read now"),
    ("read https://www.site.example now", "read now"),
    ("go www.site.example/x now", "go now"),
    ("owww.tail kept", "o kept"),
    ("HTTP://SITE.example stays", "http site example stays"),
    ("http://site.example<br>after", "after"),
    ("LOUD Words", "loud words"),
    ("Well! Really... yes?", "well really yes"),
    ("9 out of 10", "9 out of 10"),
    ("far   too\t\n many", "far too many"),
    ("  edges  ", "edges"),
    ("naïve café", "na ve caf"),
    ("!@#$%^*()", ""),
    ("<br /><p></p>", ""),
    ("", ""),
    ("   ", ""),
    ("\t\n\r", ""),
    (None, ""),
    ("http://a\u00a0b", "b"),  # a no-break space ends an address
    ("http://a\u2003b", "b"),
    ("http://a\x1cb", "b"),
    ("one\u2003two\u3000three", "one two three"),
    ("\u212a2", "k2"),  # the Kelvin sign lowercases to k
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, raw string")
    steps = X.clean_steps(F.col("raw"))
    out = df.select("id", "raw", X.clean(F.col("raw")).alias("clean"), steps["cleaned"].alias("stepwise"))
    return {r["id"]: r for r in out.withColumn("again", X.clean(F.col("clean"))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[0])[:30] for c in CASES])
def test_clean(cleaned, i):
    assert cleaned[i]["clean"] == CASES[i][1]


def test_steps_end_in_the_same_text(cleaned):
    assert all(r["clean"] == r["stepwise"] for r in cleaned.values())


def test_clean_is_idempotent(cleaned):
    assert all(r["clean"] == r["again"] for r in cleaned.values())


def test_long_text_is_processed_whole(spark):
    raw = "Word! " * 20_000
    row = spark.createDataFrame([(raw,)], "raw string").select(X.clean(F.col("raw")).alias("c")).first()
    assert row["c"] == ("word " * 20_000).strip()


def test_legacy_normalise_strips_unicode_whitespace_only_at_the_ends(spark):
    df = spark.createDataFrame([("\u00a0\tA b<br>\u3000",)], "t string")
    assert df.select(X.legacy_normalise(F.col("t"))).first()[0] == "a b<br>"


def test_blank_filter(spark):
    df = spark.createDataFrame([("a",), (" ",), ("\u00a0\u2003",), ("",), (None,)], "t string")
    assert [r["t"] for r in df.filter(X.is_not_blank(F.col("t"))).collect()] == ["a"]


def test_accents(spark):
    texts = ["Caf\u00e9 \ufb01n \u212b", "plain", None, "", "e\u0301\u0323x \u00bd \u2167 \uac01\ud55c\uae00 \ud7a3", "\U0001d400\u0344 \u3300 \ufdfa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.without_accents(F.col("t"))).collect()]
    assert got == [t if t is None else by_definition(t) for t in texts] and got[0] == "Cafe fin A"


def by_definition(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_accents_of_every_character(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    lines = ["-".join(chars[i: i + 500]) for i in range(0, len(chars), 500)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", X.without_accents(F.col("t")).alias("p")).collect()}
    assert [i for i, line in enumerate(lines) if got[i] != by_definition(line)] == []


def test_accents_need_no_python(spark):
    plan = spark.range(1).select(X.without_accents(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_residual_markup(spark):
    df = spark.createDataFrame([("a <br",), ("a </",), ("&amp;",), ("a",)], "t string")
    assert [r[0] for r in df.select(X.has_residual_markup(F.col("t"))).collect()] == [True, True, True, False]


def test_bigrams_are_built_after_short_words_are_dropped(spark):
    df = spark.createDataFrame([("so i saw it",), ("i",), ("",)], "c string").withColumn("t", word_tokens(F.col("c")))
    rows = df.select(ngram_terms(F.col("t"), (1, 2)).alias("g")).collect()
    assert rows[0]["g"] == ["so", "saw", "it", "so saw", "saw it"]
    assert rows[1]["g"] == [] and rows[2]["g"] == []


def test_wider_ngram_ranges(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc"],)], "t array<string>")
    row = df.select(
        ngram_terms(F.col("t"), (1, 3)).alias("a"), ngram_terms(F.col("t"), (2, 3)).alias("b")
    ).first()
    assert row["a"] == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert row["b"] == ["aa bb", "bb cc", "aa bb cc"]


def test_raw_and_legacy_tokens(spark):
    df = spark.createDataFrame([("It's <br />Café-bar, a 1!",)], "t string")
    row = df.select(raw_word_tokens(F.lower("t")).alias("raw"), legacy_tokens(F.col("t")).alias("legacy")).first()
    assert row["raw"] == ["it", "br", "café", "bar"]
    assert row["legacy"] == ["it's", "br", "café", "bar", "a", "1"]


def test_patterns_are_tried_only_where_they_can_match(spark):
    """Cleaning equals the chain of all its steps, whichever of the marks a text holds, and skips what can't match."""
    parts = ["plain Text", "<b>x</b>", "&amp;", "&#39;", "http://a.b/c?d&e;f", "www.x<i>", "htt<b>p://q", "&am<b>p;", "ww<w.", "<", "https:/"]
    texts = [a + s + b for a in parts for b in parts for s in (" ", "")] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.clean(F.col("t")).alias("a"), X.clean_steps(F.col("t"))["cleaned"].alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    plan = df.select(X.clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(" in plan and f", {mark})" in plan for mark in ("<", "&", "http", "www."))

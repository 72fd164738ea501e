"""Term statistics and bounded vocabularies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from reviewlens.functions.tokens import CLEANED, WordPath, cleaned_words, ngram_terms
from reviewlens.operators.rows import ROW, spread_rows
from reviewlens.session import COUNTED_BYTES, byte_size, input_bytes, join_by_size, materialise, measure


def count_at_cut(table: DataFrame, count: str, k: int) -> Row | None:
    """``at``, the k-th largest count, and ``above``, how many rows lie above it; None if there are no k rows."""
    down = Window.orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, 0)
    # Distinct counts grow with the square root of the corpus at most, so one task is enough.
    return (
        table.groupBy(count).agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(down))
        .filter(F.col("_upto") >= k)
        .agg(F.max(F.struct(F.col(count).alias("at"), (F.col("_upto") - F.col("_n")).alias("above"))).alias("c"))
        .first()["c"]
    )


def top_by_count(table: DataFrame, count: str, ties: list[str], k: int) -> DataFrame:
    """The k rows with the largest count; among equal counts the smallest ``ties``.

    A plain ORDER BY ... LIMIT k makes every task send k rows to one task, which for a
    vocabulary of tens of thousands and thousands of tasks is too much. Here the counts'
    histogram gives the count at the cut; rows above it are a filter, and only rows exactly
    at the cut, which at size are few, are ordered. ``table`` is read three times, so it
    should be a materialised one.
    """
    cut = count_at_cut(table, count, k)
    if cut is None:  # no more than k rows in all
        return table
    above = table.filter(F.col(count) > cut["at"])
    at = table.filter(F.col(count) == cut["at"]).orderBy(*ties).limit(k - cut["above"])
    return above.unionByName(at)


def row_tokens(
    docs: DataFrame, keys: list[str], text: str, carry: list[str] = [], path: WordPath = CLEANED, part_bytes: int | None = None
) -> DataFrame:
    """(keys, carry, ROW, empty, _tokens), one row per document; its text is left behind."""
    return (
        spread_rows(docs, keys, text, carry, part_bytes)
        .withColumn("_clean", path.prepare(F.col(text)))
        .select(*keys, *carry, *ROW, (F.col("_clean") == "").alias("empty"), path.cut(F.col("_clean")).alias("_tokens"))
    )


def term_rows(
    docs: DataFrame, keys: list[str], text: str, ngram_range: tuple[int, int], carry: list[str] = [], path: WordPath = CLEANED
) -> DataFrame:
    """(keys, carry, ROW, empty, term), one row per occurrence and one more with a null term per document."""
    grams = ngram_terms(F.col("_tokens"), ngram_range)
    # Nothing but keys and flags may pass the explode: a text would be copied per word.
    return row_tokens(docs, keys, text, carry, path, COUNTED_BYTES).select(
        *keys, *carry, *ROW, "empty", F.explode(F.concat(grams, F.array(F.lit(None).cast("string")))).alias("term"))


def first_and_again(docs: DataFrame, text: str, ngram_range: tuple[int, int], carry: list[str] = [], path: WordPath = CLEANED) -> DataFrame:
    """(carry, first, term), one row per occurrence; ``first`` marks one occurrence of each term in each document.

    Repeats are told apart in the sorted terms of a text, so terms can be counted over all documents without being
    counted per document before.
    """
    grams = row_tokens(docs, [], text, carry, path).select(
        *carry, F.sort_array(ngram_terms(F.col("_tokens"), ngram_range)).alias("_grams"))
    again = F.filter("_grams", lambda term, i: term == F.get(F.col("_grams"), i - 1))
    parted = grams.select(*carry, F.array_distinct("_grams").alias("_once"), again.alias("_again"))
    rows = parted.select(*carry, F.size("_once").alias("_n"), F.posexplode(F.concat("_once", "_again")).alias("_pos", "term"))
    return rows.select(*carry, (F.col("_pos") < F.col("_n")).alias("first"), "term")


def term_counts(
    docs: DataFrame, keys: list[str], text: str, ngram_range: tuple[int, int], carry: list[str] = [], path: WordPath = CLEANED
) -> DataFrame:
    """(keys, carry, ROW, empty, term, tf); a document without terms keeps one row with a null term.

    Documents are spread before their words are exploded: long ones land anywhere, and all later
    work per document finds its rows already together. ROW tells documents apart that share a key.
    """
    return (
        row_tokens(docs, keys, text, carry, path, COUNTED_BYTES)
        # Nothing but keys and flags may pass the explode: a text would be copied per word.
        .select(
            *keys, *carry, *ROW, "empty",
            F.explode_outer(ngram_terms(F.col("_tokens"), ngram_range)).alias("term"),
        )
        .groupBy(*keys, *carry, *ROW, "empty", "term")
        .agg(F.count("term").alias("tf"))
    )


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: a materialised table (term, term_id, ctf, df, idf, ...)."""

    table: DataFrame
    size_bytes: int
    size: int
    n_docs: int
    n_pos: int
    ngram_range: tuple[int, int]
    path: WordPath = CLEANED


@dataclass(frozen=True)
class TermSketch:
    """Sizes of the pass that rules out rare terms before terms are counted."""

    buckets: int = 1 << 20  # counters, each for all terms of one hash; the ids of all take 8 MB
    sample_of: int = 16  # one document of so many gives the lower bound
    # Below so many bytes of input the texts are read once instead of twice.
    least_bytes: int = 1 << 30


def frequent_buckets(
    docs: DataFrame, text: str, limits: list[tuple[int, tuple[int, int]]], sketch: TermSketch, path: WordPath
) -> DataFrame | None:
    """(bucket) of all terms that can be among the most frequent of some limit; None if all terms can.

    Proof that no term of a vocabulary is lost. Let c be the count of the k-th term. In a sample of the
    documents every count is at most the whole count, so at least k terms have whole counts of no less than
    the k-th count in the sample, s; hence s <= c. A bucket's counter is the sum of the counts of its terms. So a
    term of the vocabulary, the ones that tie at the cut included, has count >= c >= s, and its bucket's counter
    is >= s: the bucket is kept, and with it each occurrence of the term.
    """
    widest = (min(r[0] for _, r in limits), max(r[1] for _, r in limits))
    tokens = docs.select(F.col(text), path.cut(path.prepare(F.col(text))).alias("_tokens"))
    sample = tokens.filter(F.pmod(F.xxhash64(text, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(sketch.sample_of)) == 0)
    sampled = materialise(
        sample.select(F.explode(ngram_terms(F.col("_tokens"), widest)).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    least = None
    for k, ngram_range in limits:
        own = sampled if ngram_range == widest else sampled.filter(term_words().between(*ngram_range))
        cut = count_at_cut(own, "n", k)
        if cut is None:
            return None  # the sample has fewer than k terms, so nothing is known of the cut
        least = cut["at"] if least is None else min(least, cut["at"])
    if least <= 1:
        return None
    counted = tokens.select(F.explode(ngram_terms(F.col("_tokens"), widest)).alias("term")).groupBy(
        bucket_of("term", sketch).alias("bucket")).agg(F.count("*").alias("n"))
    return materialise(counted.filter(F.col("n") >= least).select("bucket"))


def bucket_of(term: str, sketch: TermSketch) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(sketch.buckets)).cast("int")


def term_words() -> Column:
    return F.size(F.split("term", " "))


def count_terms(
    docs: DataFrame, text: str, limits: list[tuple[int, tuple[int, int]]], label: str | None, sketch: TermSketch, path: WordPath
) -> DataFrame:
    """(term, ctf, df, df_pos with a label) of at least all terms that any of the limits keeps."""
    widest = (min(r[0] for _, r in limits), max(r[1] for _, r in limits))
    carry = [label] if label else []
    kept = frequent_buckets(docs, text, limits, sketch, path) if input_bytes(docs) >= sketch.least_bytes else None
    terms = first_and_again(docs, text, widest, carry, path)
    if kept is not None:
        # At most sketch.buckets numbers, so the broadcast is bounded whatever the corpus holds.
        terms = terms.withColumn("bucket", bucket_of("term", sketch)).join(F.broadcast(kept), "bucket", "left_semi")
    return terms.groupBy("term").agg(
        F.count("*").alias("ctf"),
        F.count_if("first").alias("df"),
        *([F.sum(F.when(F.col("first"), F.col(label).cast("long"))).alias("df_pos")] if label else []),
    )


def fit_vocabularies(
    docs: DataFrame,
    keys: list[str],
    text: str,
    limits: list[tuple[int, tuple[int, int]]],
    label: str | None = None,
    sketch: TermSketch = TermSketch(),
    path: WordPath = CLEANED,
) -> list[Vocabulary]:
    """One vocabulary per (max_features, ngram_range), all from one count of the terms.

    Each holds the terms with the largest total frequency, their document frequency and
    smooth idf, and with ``label`` also ``df_pos``, the positive documents with the term.
    Rows that repeat a key are documents of their own. From ``sketch.least_bytes`` on, rare
    terms are ruled out before any term is shuffled; the result is the same.
    """
    positive = F.sum(F.col(label).cast("long")) if label else F.lit(0).cast("long")
    totals = docs.agg(F.count("*").alias("n"), F.coalesce(positive, F.lit(0)).alias("pos")).first()
    widest = (min(r[0] for _, r in limits), max(r[1] for _, r in limits))
    per_term = materialise(count_terms(docs, text, limits, label, sketch, path))
    idf = F.log((F.lit(1.0) + F.lit(totals["n"])) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    fitted = []
    for max_features, ngram_range in limits:
        terms = per_term if ngram_range == widest else per_term.filter(term_words().between(*ngram_range))
        top = top_by_count(terms, "ctf", ["term"], max_features)
        # At most max_features rows are left, so one window over all of them is fine.
        term_id = (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
        table = materialise(top.withColumn("term_id", term_id).withColumn("idf", idf))
        rows, size_bytes = measure(table)
        fitted.append(Vocabulary(table, size_bytes, rows, totals["n"], totals["pos"], ngram_range, path))
    return fitted


def fit_vocabulary(
    docs: DataFrame,
    keys: list[str],
    text: str,
    max_features: int,
    ngram_range: tuple[int, int],
    label: str | None = None,
    sketch: TermSketch = TermSketch(),
    path: WordPath = CLEANED,
) -> Vocabulary:
    return fit_vocabularies(docs, keys, text, [(max_features, ngram_range)], label, sketch, path)[0]


@dataclass(frozen=True)
class WordIndex:
    """Words ranked from 1; 0 is left for padding."""

    table: DataFrame
    size_bytes: int
    num_words: int


def fit_word_index(
    docs: DataFrame, key: str, text: str, num_words: int, words_of: Callable[[Column], Column] = cleaned_words
) -> WordIndex:
    """The num_words - 1 most frequent words; equal counts go by first appearance.

    First means the smallest key, of any type that has an order (null comes last), then the first place in its
    text. Counting needs the key of a word's first text only; the place is looked up afterwards, in the
    texts of these keys, for the words that can be in the index.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    seen = docs.select("_key", F.explode(words_of(F.col("_text"))).alias("word"))
    words = materialise(seen.groupBy("word").agg(F.count("*").alias("cnt"), F.min("_key").alias("_first")))
    k = num_words - 1
    cut = count_at_cut(words, "cnt", k)
    kept = words
    if cut is not None:
        # All words above the cut, and those at it that first appear no later than the last one needed.
        at = words.filter(F.col("cnt") == cut["at"])
        last = at.orderBy(F.col("_first").asc_nulls_last()).limit(k - cut["above"]).agg(
            F.max("_first").alias("key"), F.count_if(F.col("_first").isNull()).alias("without")).first()
        early = F.lit(True) if last["without"] else F.col("_first") <= F.lit(last["key"])
        kept = words.filter(F.col("cnt") > cut["at"]).unionByName(at.filter(early))
    kept = materialise(kept)
    size, unkeyed = kept.agg(
        F.coalesce(F.sum(F.octet_length("word") + F.octet_length(F.col("_first").cast("string")) + 32), F.lit(0)),
        F.coalesce(F.bool_or(F.col("_first").isNull()), F.lit(False))).first()
    firsts = kept.select(F.col("_first").alias("_key")).distinct()
    # A null key joins nothing; the words that only such texts have are looked up there.
    found = join_by_size(docs.filter("_key IS NOT NULL"), firsts, ["_key"], "left_semi", size, ["_text"])
    found = found.unionByName(docs.filter("_key IS NULL")) if unkeyed else found
    places = found.select("_key", F.posexplode(words_of(F.col("_text"))).alias("pos", "word"))
    near = join_by_size(places, kept, ["word"], "inner", size, ["_key", "pos"]).filter(F.col("_key").eqNullSafe(F.col("_first")))
    placed = materialise(near.groupBy("word", "cnt", "_first").agg(F.min("pos").alias("_pos")))
    # A little more than num_words rows are left, so one window over all of them is fine.
    rank = Window.orderBy(F.col("cnt").desc(), F.col("_first").asc_nulls_last(), "_pos")
    table = materialise(placed.withColumn("idx", F.row_number().over(rank)).filter(F.col("idx") <= k).select("word", "idx", "cnt"))
    return WordIndex(table, byte_size(table), num_words)

import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import sequences as S
from reviewlens.operators import tfidf, vocabulary, wordpiece
from reviewlens.functions.tokens import UNCLEANED, cleaned_words, legacy_tokens
from reviewlens.operators.vocabulary import TermSketch, fit_vocabulary, fit_word_index, frequent_buckets, top_by_count
from reviewlens.session import byte_size, join_by_size, materialise

KEY = ["doc_id"]
TEXTS = {
    1: "good good plot and good cast",
    2: "bad plot and bad cast",
    3: "a b c",  # one-letter words only
    4: "",
    5: "the same plot the same cast",
}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")


def terms(text):
    words = [w for w in text.split() if len(w) >= 2]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute_force(texts, k, fit_on=None):
    fit_on = texts if fit_on is None else fit_on
    total, df = Counter(), Counter()
    for t in fit_on.values():
        total.update(terms(t))
        df.update(terms(t).keys())
    kept = sorted(total, key=lambda t: (-total[t], t))[:k]
    idf = {t: math.log((1 + len(fit_on)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for key, text in texts.items():
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in terms(text).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(key, t): v / norm for t, v in raw.items()} or {(key, None): None})
    return out


def as_dict(weights):
    return {(r["doc_id"], r["term"]): r["weight"] for r in weights.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(a[k] == b[k] or a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


@pytest.mark.parametrize("k", [3, 7, 1000])
def test_weights(docs, k):
    vocab = fit_vocabulary(docs, ["doc_id"], "text", k, (1, 2))
    same(as_dict(tfidf.tfidf_weights(docs, ["doc_id"], "text", vocab)), brute_force(TEXTS, k))


def test_repeats_are_told_apart(spark):
    docs = spark.createDataFrame([("aa bb aa aa bb", 1), ("bb", 0), ("", 1), (None, 0)], "text string, label int")
    rows = vocabulary.first_and_again(docs, "text", (1, 2), ["label"]).collect()
    assert Counter((r["label"], r["first"], r["term"]) for r in rows) == Counter({
        (1, True, "aa"): 1, (1, False, "aa"): 2, (1, True, "bb"): 1, (1, False, "bb"): 1, (1, True, "aa bb"): 1,
        (1, False, "aa bb"): 1, (1, True, "bb aa"): 1, (1, True, "aa aa"): 1, (0, True, "bb"): 1})


def test_weights_when_nothing_is_broadcast(docs, always_shuffle):
    vocab = fit_vocabulary(docs, ["doc_id"], "text", 7, (1, 2))
    same(as_dict(tfidf.tfidf_weights(docs, ["doc_id"], "text", vocab)), brute_force(TEXTS, 7))


def test_transform_uses_the_frozen_vocabulary(spark, docs):
    vocab = fit_vocabulary(docs, ["doc_id"], "text", 1000, (1, 2))
    other = {11: "good unheard words", 12: "nothing known here", 13: ""}
    df = spark.createDataFrame(list(other.items()), "doc_id bigint, text string")
    got = as_dict(tfidf.tfidf_weights(df, ["doc_id"], "text", vocab))
    same(got, brute_force(other, 1000, fit_on=TEXTS))
    assert got[(12, None)] is None and got[(13, None)] is None


def zipf_texts(n=120):
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return {i: " ".join(random.choices(words, weights, k=random.randint(0, 60))) for i in range(n)}


@pytest.mark.parametrize("buckets", [1, 16, 256, 1 << 16])
@pytest.mark.parametrize("k", [5, 40, 300, 100_000])
def test_ruling_out_rare_terms_loses_none(spark, buckets, k):
    """From one counter for all terms to one for each, and cuts from high up to below the last term, ties included."""
    texts = zipf_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    plain, pruned = (
        {tuple(r) for r in fit_vocabulary(docs, KEY, "text", k, (1, 2), sketch=sketch).table.collect()}
        for sketch in (TermSketch(), TermSketch(buckets, 3, least_bytes=0)))
    total = Counter()
    for text in texts.values():
        total.update(terms(text))
    assert plain == pruned and {r[0] for r in plain} == set(sorted(total, key=lambda t: (-total[t], t))[:k])


def test_rare_terms_are_ruled_out(spark):
    docs = spark.createDataFrame(list(zipf_texts(400).items()), "doc_id bigint, text string")
    sketch = TermSketch(1 << 16, 4, least_bytes=0)
    kept = frequent_buckets(docs, "text", [(50, (1, 2))], sketch, vocabulary.CLEANED)
    all_terms = {t for text in zipf_texts(400).values() for t in terms(text)}
    assert 50 <= kept.count() < len(all_terms) / 4
    assert frequent_buckets(docs, "text", [(10**6, (1, 2))], sketch, vocabulary.CLEANED) is None


def test_several_vocabularies_from_one_pruned_count(spark):
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in zipf_texts().items()], "doc_id bigint, text string, label int")
    limits = [(30, (1, 2)), (60, (1, 1)), (20, (2, 2))]
    tables = [
        [sorted(map(tuple, v.table.collect())) for v in vocabulary.fit_vocabularies(docs, KEY, "text", limits, "label", sketch)]
        for sketch in (TermSketch(), TermSketch(64, 2, least_bytes=0))]
    assert tables[0] == tables[1]


REPEATS = [(1, "good plot"), (1, "bad cast bad"), (None, "good good"), (None, "plot"), (1, "good plot"), (2, ""), (None, None)]


def test_rows_that_share_a_key_stay_apart(spark):
    docs = spark.createDataFrame(REPEATS, "doc_id bigint, text string")
    vocab = fit_vocabulary(docs, KEY, "text", 1000, (1, 1))
    assert {(r["term"], r["ctf"], r["df"]) for r in vocab.table.collect()} == {
        ("good", 4, 3), ("plot", 3, 3), ("bad", 2, 1), ("cast", 1, 1)} and vocab.n_docs == 7
    weights = tfidf.tfidf_weights(docs, KEY, "text", vocab).collect()
    assert Counter((r["doc_id"], r["term"]) for r in weights) == Counter(
        [(1, "good"), (1, "plot"), (1, "bad"), (1, "cast"), (None, "good"), (None, "plot"), (1, "good"), (1, "plot"), (2, None), (None, None)])
    assert sum(r["weight"] ** 2 for r in weights if r["weight"]) == pytest.approx(5)
    assert tfidf.vector_table(docs, KEY, "text", vocab).count() == 7
    index = fit_word_index(docs, "doc_id", "text", 10)
    ids = {r["word"]: r["idx"] for r in index.table.collect()}
    got = S.text_sequences(docs, "doc_id", "text", index).collect()
    want = [(k, tuple(ids[w] for w in (t or "").split())) for k, t in REPEATS]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter(want)


def test_many_copies_of_one_row_are_spread(spark):
    docs = spark.range(0, 400, 1, 8).select(F.lit(7).alias("doc_id"), F.lit("good plot").alias("text"))
    spots = tfidf.term_counts(docs, KEY, "text", (1, 1)).select("_spot").distinct().count()
    assert spots == 8 and tfidf.term_counts(docs, KEY, "text", (1, 1)).count() == 800


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "double"])
@pytest.mark.parametrize("k", [2, 3, 4, 5, 9])
def test_word_index_keys_of_any_type(spark, kind, k):
    rows = [(3, "zeta beta omega"), (1, "beta alpha i"), (2, "zeta gamma rho"), (None, "none alpha"), (None, "last")]
    docs = spark.createDataFrame(rows, "n int, text string")
    key = F.date_add(F.lit("2020-01-01"), "n") if kind == "date" else F.concat(F.lit("k"), "n") if kind == "string" else F.col("n").cast(kind)
    index = fit_word_index(docs.select(key.alias("key"), "text"), "key", "text", k)
    words = [w for _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)) for w in text.split()]
    # Texts without a key come last; among them places alone decide, which ties here.
    count, first = Counter(words), {w: words.index(w) for w in words}
    want = sorted(count, key=lambda w: (-count[w], first[w]))[:k - 1]
    got = [r["word"] for r in index.table.orderBy("idx").collect()]
    assert got == want or k == 9 and sorted(got) == sorted(want)


def test_uncleaned_texts(spark):
    docs = spark.createDataFrame([(1, "<b>Caf\u00e9</b> CAFE! don't"), (2, "  "), (3, None)], "doc_id bigint, text string")
    vocab = fit_vocabulary(docs, KEY, "text", 100, (1, 1), path=UNCLEANED)
    assert {r["term"]: r["ctf"] for r in vocab.table.collect()} == {"cafe": 2, "don": 1}
    weights = tfidf.tfidf_weights(docs, KEY, "text", vocab).collect()
    assert {(r["doc_id"], r["term"]) for r in weights} == {(1, "cafe"), (1, "don"), (2, None), (3, None)}


def test_uncleaned_and_cleaned_models_do_not_share_a_pass(spark, tiny_reviews):
    a, b = (tfidf.class_log_odds_model(tiny_reviews, KEY, "text", "label", 100, (1, 1), k) for k in "ab")
    b = replace(b, vocab=replace(b.vocab, path=UNCLEANED))
    with pytest.raises(ValueError):
        tfidf.score_models(tiny_reviews, KEY, "text", [a, b])


def test_sequences_of_raw_words(spark):
    docs = spark.createDataFrame([(1, "It's a <b>dog</b>, it's"), (2, None)], "doc_id bigint, text string")
    index = fit_word_index(docs, "doc_id", "text", 50, legacy_tokens)
    assert {r["word"] for r in index.table.collect()} == {"it's", "a", "b", "dog"}
    got = {r["doc_id"]: r["words"] for r in S.text_sequences(docs, "doc_id", "text", index, words_of=legacy_tokens).collect()}
    assert got == {1: ["it's", "a", "b", "dog", "b", "it's"], 2: []}


def test_vectors_agree_with_weights(docs):
    vocab = fit_vocabulary(docs, ["doc_id"], "text", 1000, (1, 2))
    ids = {r["term"]: r["term_id"] for r in vocab.table.collect()}
    assert sorted(ids.values()) == list(range(vocab.size)) and sorted(ids) == [t for t, _ in sorted(ids.items(), key=lambda x: x[1])]
    want = brute_force(TEXTS, 1000)
    for row in tfidf.vector_table(docs, ["doc_id"], "text", vocab).collect():
        got = dict(zip(row["features"].indices.tolist(), row["features"].values.tolist()))
        mine = {ids[t]: v for (d, t), v in want.items() if d == row["doc_id"] and t}
        assert row["features"].size == vocab.size and got == pytest.approx(mine)


def test_top_by_count_breaks_ties_at_the_cut(spark):
    rows = [(f"w{i:02d}", 5 if i < 2 else 3 if i < 10 else 1) for i in range(30)]
    table = spark.createDataFrame(rows, "term string, n bigint")
    for k in (1, 2, 3, 6, 10, 11, 30, 99):
        got = {r["term"] for r in top_by_count(table, "n", ["term"], k).collect()}
        assert got == {t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_word_index_orders_ties_by_first_appearance(spark):
    docs = spark.createDataFrame([(1, "zeta beta"), (2, "beta alpha i"), (3, "zeta gamma")], "doc_id bigint, text string")
    got = {r["word"]: r["idx"] for r in fit_word_index(docs, "doc_id", "text", 5).table.collect()}
    assert got == {"zeta": 1, "beta": 2, "alpha": 3, "i": 4}


def test_sequences_keep_order_and_empty_texts(spark):
    docs = spark.createDataFrame(
        [(1, "beta zeta beta"), (2, "unheard"), (3, ""), (4, None)], "doc_id bigint, text string"
    )
    index = fit_word_index(docs.filter("doc_id = 1"), "doc_id", "text", 5000)
    got = {r["doc_id"]: r["ids"] for r in S.text_sequences(docs, "doc_id", "text", index).collect()}
    assert got == {1: [1, 2, 1], 2: [], 3: [], 4: []}


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([7],), ([],)], "ids array<int>")
    rows = df.select(S.pad_front(F.col("ids"), 4).alias("f"), S.pad_back(F.col("ids"), 4).alias("b")).collect()
    assert [r["f"] for r in rows] == [[3, 4, 5, 6], [0, 0, 0, 7], [0, 0, 0, 0]]
    assert [r["b"] for r in rows] == [[1, 2, 3, 4], [7, 0, 0, 0], [0, 0, 0, 0]]


def test_wordpiece_equals_a_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = {
        1: "running runner runs the marathon",
        2: "unheardofword x" + "y" * 120,
        3: "",
        4: "the " * 300,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pieces = spark.createDataFrame(
        [(p, i) for i, p in enumerate(
            wordpiece.SPECIAL + list("abcdefghijklmnopqrstuvwxyz") + [f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
            + ["run", "##ning", "##ner", "the", "mara", "##thon", "un", "##heard"]
        )], "piece string, piece_id int",
    )
    vocab = {r["piece"]: r["piece_id"] for r in pieces.collect()}
    other = tokenizers.Tokenizer(tokenizers.models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    other.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    encoded = wordpiece.encode(docs, ["doc_id"], "text", pieces, 256)
    assert "Python" not in encoded._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in encoded.collect()}
    for key, text in texts.items():
        ids = [2, *other.encode(text.strip()).ids[:254], 3]
        assert got[key]["input_ids"] == ids + [0] * (256 - len(ids))
        assert got[key]["attention_mask"] == [1] * len(ids) + [0] * (256 - len(ids))
        assert got[key]["empty"] == (text == "")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join_on_a_hot_key(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(i, f"v{i}") for i in range(25)], "k bigint, v string")
    joined = [
        sorted(map(tuple, join_by_size(left, right, ["k"], how, byte_size(right), ["id"], limit).collect()))
        for limit in (1 << 20, 0)
    ]
    assert joined[0] == joined[1]


def test_salted_join_refuses_other_kinds(spark):
    with pytest.raises(ValueError):
        join_by_size(spark.range(1), spark.range(1), ["id"], "full", 0, ["id"])


@pytest.fixture
def piece_texts(spark):
    rows = [(1, "warm pictures and warmest zz"), (1, "and unwarm"), (None, ""), (2, "x" * 101), (3, None)]
    vocabulary = [*wordpiece.SPECIAL, *"adehimnprstuwxz", *(f"##{c}" for c in "adeimnrstuwxz"), "warm", "and", "##est", "picture"]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        materialise(spark.createDataFrame([(p, i) for i, p in enumerate(vocabulary)], "piece string, piece_id int")),
    )


def piece_ids(df):
    return sorted([tuple(r["input_ids"]) for r in df.select("input_ids").collect()])


def test_words_that_are_pieces_are_not_cut_and_words_move_before_they_are_exploded(piece_texts, monkeypatch):
    docs, vocabulary = piece_texts
    cut, own = [], wordpiece.word_pieces
    monkeypatch.setattr(wordpiece, "word_pieces", lambda words, v: cut.extend(r["word"] for r in words.collect()) or own(words, v))
    encoded = wordpiece.encode(docs, ["doc_id"], "text", vocabulary, 16)
    assert sorted(cut) == ["pictures", "unwarm", "warmest", "x" * 101, "zz"]
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_wordpiece_when_cut_words_are_too_many_to_broadcast(piece_texts, monkeypatch):
    docs, vocabulary = piece_texts
    broadcast = piece_ids(wordpiece.encode(docs, ["doc_id"], "text", vocabulary, 16))
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", 250)
    monkeypatch.setattr(wordpiece, "byte_size", lambda df: 0)  # the vocabulary is bounded
    far = wordpiece.encode(docs, ["doc_id"], "text", vocabulary, 16)
    assert "_salt" not in far._jdf.queryExecution().executedPlan().toString()
    assert len(broadcast) == 5 and piece_ids(far) == broadcast
    pieces = {r["piece"]: r["piece_id"] for r in vocabulary.collect()}
    first = [2, pieces["warm"], pieces["picture"], pieces["##s"], pieces["and"], pieces["warm"], pieces["##est"], pieces["z"], pieces["##z"], 3]
    assert tuple(first + [0] * (16 - len(first))) in broadcast and (2, 1, 3, *[0] * 13) in broadcast


@pytest.mark.parametrize("cut", [cleaned_words, legacy_tokens])
def test_sequences_by_lookup_equal_those_by_join(spark, monkeypatch, cut):
    texts = ["b a  a zz", None, "", "unknown", "A <br> b! 'b c-d", "ü aüb a", "a a", " b\t"] * 90
    docs = spark.createDataFrame([(i if i % 5 else None, t, i % 3) for i, t in enumerate(texts)], "doc_id bigint, text string, mark int")
    index = fit_word_index(docs.filter("doc_id IS NOT NULL AND text <> 'unknown'"), "doc_id", "text", 4, words_of=cut)

    def rows():
        found = S.text_sequences(docs, "doc_id", "text", index, ["mark"], cut)
        return found.columns, [f.dataType for f in found.schema.fields], sorted(map(str, found.collect()))

    looked_up = rows()
    monkeypatch.setattr("reviewlens.session.BROADCAST_LIMIT_BYTES", -1)
    joined = rows()
    assert looked_up[0] == joined[0] and looked_up[2] == joined[2]
    assert len(joined[2]) == len(texts)
    assert [t.simpleString() for t in looked_up[1]] == [t.simpleString() for t in joined[1]]

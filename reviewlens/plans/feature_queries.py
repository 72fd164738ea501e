"""Queries on tokens, vocabularies, weights and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.config import JobConfig
from reviewlens.functions.text import clean
from reviewlens.functions.tokens import legacy_tokens as split_legacy
from reviewlens.functions.tokens import UNCLEANED, word_tokens
from reviewlens.operators import sequences as S
from reviewlens.operators import tfidf, wordpiece as W
from reviewlens.operators.vocabulary import TermSketch, Vocabulary, fit_vocabulary, fit_word_index, term_counts
from reviewlens.plans import oracle as O
from reviewlens.plans.text_queries import _train_val
from reviewlens.sources import reviews as R

CONFIG = JobConfig()
KEY = ["doc_id"]


def _fit(docs: DataFrame) -> Vocabulary:
    return fit_vocabulary(docs, KEY, "text", CONFIG.max_features, CONFIG.ngram_range)


def _joined(ids: str) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = word_tokens(clean(F.col("text")))
    return R.read_documents(spark, sf).select("doc_id", F.posexplode(words).alias("pos", "token"))


def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    counts = term_counts(R.read_documents(spark, sf), KEY, "text", CONFIG.ngram_range)
    return counts.filter(F.col("term").isNotNull()).select("doc_id", "term", "tf")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(R.labelled_reviews(spark, sf)).table.select("term", "term_id", "ctf")


def vocabulary_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same with rare terms ruled out first, as it is done for large inputs."""
    docs = R.labelled_reviews(spark, sf)
    pruned = fit_vocabulary(docs, KEY, "text", 2_000, CONFIG.ngram_range, sketch=TermSketch(1 << 16, 4, least_bytes=0))
    return pruned.table.select("term", "term_id", "ctf", "df")


def uncleaned_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as they are, markup and symbols included; only case and accents are levelled."""
    vocab = fit_vocabulary(R.read_pages(spark, sf), ["page_id"], "html", CONFIG.max_features, CONFIG.ngram_range, path=UNCLEANED)
    return vocab.table.select("term", "term_id", "ctf", "df")


def uncleaned_weights(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.read_pages(spark, sf)
    vocab = fit_vocabulary(pages, ["page_id"], "html", CONFIG.max_features, CONFIG.ngram_range, path=UNCLEANED)
    weights = tfidf.tfidf_weights(pages, ["page_id"], "html", vocab)
    return weights.select("page_id", "term", F.round("weight", 6).alias("weight"))


def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(R.labelled_reviews(spark, sf)).table.select("term", "df")


def idf(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(R.labelled_reviews(spark, sf)).table.select("term", F.round("idf", 6).alias("idf"))


def vocab_size(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(R.labelled_reviews(spark, sf)).table.agg(F.count("*").alias("vocab_size"))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf)
    weights = tfidf.tfidf_weights(docs, KEY, "text", _fit(docs))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_transform_val(spark: SparkSession, sf: str) -> DataFrame:
    docs = _train_val(spark, sf)
    vocab = _fit(docs.filter("split = 'train'"))
    weights = tfidf.tfidf_weights(docs.filter("split = 'val'"), KEY, "text", vocab)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def sparse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.labelled_reviews(spark, sf)
    vectors = tfidf.sparse_vectors(docs, KEY, "text", _fit(docs))
    return vectors.select(
        "doc_id",
        F.size("features.indices").cast("long").alias("n_terms"),
        _joined("features.indices").alias("indices"),
        F.round(F.aggregate("features.values", F.lit(0.0), lambda a, v: a + v), 6).alias("value_sum"),
    )


def word_index(spark: SparkSession, sf: str) -> DataFrame:
    return fit_word_index(R.read_documents(spark, sf), "doc_id", "text", CONFIG.num_words).table


def legacy_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return R.read_pages(spark, sf).select("page_id", F.posexplode(split_legacy(F.col("html"))).alias("pos", "token"))


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.read_documents(spark, sf).select("doc_id", "text")
    return S.text_sequences(docs, "doc_id", "text", fit_word_index(docs, "doc_id", "text", CONFIG.num_words))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(spark, sf).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), _joined("ids").alias("ids")
    )


def padded_sequences(spark: SparkSession, sf: str) -> DataFrame:
    padded = _sequences(spark, sf).select("doc_id", S.pad_front(F.col("ids"), CONFIG.max_len).alias("ids"))
    return padded.select("doc_id", F.size("ids").cast("long").alias("length"), _joined("ids").alias("ids"))


def legacy_word_index(spark: SparkSession, sf: str) -> DataFrame:
    """Words of pages that were not cleaned: punctuation is blanked, apostrophes stay."""
    return fit_word_index(R.read_pages(spark, sf), "page_id", "html", CONFIG.num_words, split_legacy).table


def legacy_sequences(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.read_pages(spark, sf)
    index = fit_word_index(pages, "page_id", "html", CONFIG.num_words, split_legacy)
    found = S.text_sequences(pages, "page_id", "html", index, words_of=split_legacy)
    return found.select("page_id", F.size("ids").cast("long").alias("n_ids"), _joined("ids").alias("ids"))


def repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Every document twice as it is, and its first half once more without a key."""
    docs = R.read_documents(spark, sf).select("doc_id", "text")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return docs.unionByName(docs).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), half.alias("text")))


def sequences_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """One sequence per row, also where rows share a key or have none."""
    index = fit_word_index(R.read_documents(spark, sf), "doc_id", "text", CONFIG.num_words)
    found = S.text_sequences(repeated(spark, sf), "doc_id", "text", index)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), _joined("ids").alias("ids"))


def weights_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Squared lengths of all rows' vectors, and how many weights they have, by key."""
    weights = tfidf.tfidf_weights(repeated(spark, sf), KEY, "text", _fit(R.labelled_reviews(spark, sf)))
    return weights.groupBy("doc_id").agg(
        F.count("term").alias("n_weights"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"))


def wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.read_documents(spark, sf)
    index = fit_word_index(docs, "doc_id", "text", CONFIG.num_words)
    encoded = W.encode(docs, KEY, "text", W.piece_vocabulary(index), CONFIG.max_length)
    return encoded.select(
        "doc_id",
        _joined("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).cast("long").alias("n_real"),
        F.size("input_ids").cast("long").alias("length"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokens, ngrams, vocabulary, vocabulary_pruned, uncleaned_vocabulary, uncleaned_weights, doc_freq, idf, vocab_size, tfidf_weights, tfidf_transform_val,
        sparse_vectors, word_index, legacy_tokens, legacy_word_index, legacy_sequences, sequences, padded_sequences,
        sequences_repeated_keys, weights_repeated_keys, wordpiece,
    )
}

_FIT = [O.DOCS, *O.fit("bi", "docs")]


def _weights(tf: str, model: str) -> list[str]:
    return [
        f"x AS (SELECT doc_id, term, (1.0 + ln(CAST(tf AS DOUBLE))) * idf AS x FROM {tf}_tf JOIN {model}_m USING (term))",
        "y AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM x)",
    ]


def index_ctes(src: str) -> list[str]:
    """idx: (word, idx, cnt) of the most frequent words of src."""
    return [
        f"c AS (SELECT doc_id, {O.words(O.clean('text'), 1)} AS w FROM {src})",
        "t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM c)",
        "k AS (SELECT word, count(*) AS cnt, min(doc_id * 10000000 + pos) AS first_seen FROM t GROUP BY word)",
        f"""idx AS (SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, first_seen) AS INTEGER) AS idx, cnt
  FROM k ORDER BY cnt DESC, first_seen LIMIT {O.NUM_WORDS - 1})""",
    ]


_INDEX = [
    *index_ctes("documents"),
    """seq AS (SELECT c.doc_id, coalesce(s.ids, []) AS ids FROM c LEFT JOIN
  (SELECT doc_id, list(idx ORDER BY pos) AS ids FROM t JOIN idx USING (word) GROUP BY doc_id) s USING (doc_id))""",
]

_LEGACY_WORDS = r"""list_filter(string_split(
  regexp_replace(lower(html), '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]', ' ', 'g'), ' '), lambda t: t <> '')"""
_LEGACY = [
    f"c AS (SELECT page_id AS doc_id, {_LEGACY_WORDS} AS w FROM pages)",
    *_INDEX[1:],
]

# Runs of letters, digits, marks and underscores; one character alone is no word.
_PAGES = [
    r"""raw AS (SELECT page_id AS doc_id, regexp_extract_all(strip_accents(lower(html)), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM pages)""",
    """raw_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM raw UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM raw) GROUP BY doc_id, term)""",
    f"""raw_v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM raw_tf GROUP BY term
  ORDER BY ctf DESC, term LIMIT {O.MAX_FEATURES})""",
    """raw_m AS (SELECT term, ctf, df, ln((1.0 + n) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf
  FROM raw_v, (SELECT CAST(count(*) AS DOUBLE) AS n FROM pages))""",
]
_TERM_ID = "CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id"

REPEATED = """thrice AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM documents
  UNION ALL SELECT NULL, text[1:length(text) // 2] FROM documents),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM thrice)"""

ORACLES = {
    "tokens": O.with_ctes(
        [O.EVERY, *O.term_freq("d", "every")],
        "SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS token FROM d_u",
    ),
    "ngrams": O.with_ctes([O.EVERY, *O.term_freq("d", "every")], "SELECT doc_id, term, tf FROM d_tf"),
    "vocabulary": O.with_ctes(
        _FIT, "SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, ctf FROM bi_m"
    ),
    "vocabulary_pruned": O.with_ctes(
        [O.DOCS, *O.fit("bi", "docs", k=2_000)], f"SELECT term, {_TERM_ID}, ctf, df FROM bi_m"
    ),
    "uncleaned_vocabulary": O.with_ctes(_PAGES, f"SELECT term, {_TERM_ID}, ctf, df FROM raw_m"),
    "uncleaned_weights": O.with_ctes(
        [*_PAGES, *_weights("raw", "raw")],
        "SELECT page_id, term, round(weight, 6) AS weight FROM pages LEFT JOIN y ON page_id = y.doc_id",
    ),
    "legacy_word_index": O.with_ctes(_LEGACY, "SELECT word, idx, cnt FROM idx"),
    "legacy_sequences": O.with_ctes(
        _LEGACY, "SELECT doc_id AS page_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM seq",
    ),
    "sequences_repeated_keys": O.with_ctes(
        [
            *index_ctes("documents"),
            REPEATED,
            f"n AS (SELECT rid, doc_id, {O.words(O.clean('text'), 1)} AS w FROM numbered)",
            "p AS (SELECT rid, unnest(range(len(w))) AS pos, unnest(w) AS word FROM n)",
            "s AS (SELECT rid, list(idx ORDER BY pos) AS ids FROM p JOIN idx USING (word) GROUP BY rid)",
        ],
        """SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_ids, coalesce(array_to_string(ids, ' '), '') AS ids
FROM n LEFT JOIN s USING (rid)""",
    ),
    "weights_repeated_keys": O.with_ctes(
        [
            *_FIT,
            REPEATED,
            "again AS (SELECT rid, doc_id, text FROM numbered)",
            *O.term_freq("rep", "again", "rid"),
            "x AS (SELECT rid, term FROM rep_tf JOIN bi_m USING (term))",
            "g AS (SELECT rid, count(*) AS n FROM x GROUP BY rid)",
        ],
        """SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_weights, round(CAST(nullif(count(n), 0) AS DOUBLE), 6) AS squares
FROM numbered LEFT JOIN g USING (rid) GROUP BY doc_id""",
    ),
    "doc_freq": O.with_ctes(_FIT, "SELECT term, df FROM bi_m"),
    "idf": O.with_ctes(_FIT, "SELECT term, round(idf, 6) AS idf FROM bi_m"),
    "vocab_size": O.with_ctes(_FIT, "SELECT count(*) AS vocab_size FROM bi_m"),
    "tfidf_weights": O.with_ctes(
        [*_FIT, *_weights("bi", "bi")],
        "SELECT docs.doc_id, term, round(weight, 6) AS weight FROM docs LEFT JOIN y ON docs.doc_id = y.doc_id",
    ),
    "tfidf_transform_val": O.with_ctes(
        [
            O.DOCS,
            O.train_val("s", "docs"),
            "tr AS (SELECT * FROM s WHERE split = 'train')",
            "va AS (SELECT * FROM s WHERE split = 'val')",
            *O.fit("tr1", "tr"),
            *O.term_freq("va1", "va"),
            *_weights("va1", "tr1"),
        ],
        "SELECT va.doc_id, term, round(weight, 6) AS weight FROM va LEFT JOIN y ON va.doc_id = y.doc_id",
    ),
    "sparse_vectors": O.with_ctes(
        [
            *_FIT,
            *_weights("bi", "bi"),
            "i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM bi_m)",
            """g AS (SELECT doc_id, count(*) AS n_terms, string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY term_id) AS indices,
  sum(weight) AS s FROM y JOIN i USING (term) GROUP BY doc_id)""",
        ],
        """SELECT docs.doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(indices, '') AS indices,
  round(coalesce(s, 0.0), 6) AS value_sum FROM docs LEFT JOIN g ON docs.doc_id = g.doc_id""",
    ),
    "word_index": O.with_ctes(_INDEX, "SELECT word, idx, cnt FROM idx"),
    "legacy_tokens": r"""SELECT page_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS token
FROM (SELECT page_id, list_filter(string_split(
  regexp_replace(lower(html), '[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n]', ' ', 'g'), ' '), lambda t: t <> '') AS w
  FROM pages)""",
    "sequences": O.with_ctes(
        _INDEX,
        "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM seq",
    ),
    "padded_sequences": O.with_ctes(
        [
            *_INDEX,
            """p AS (SELECT doc_id, list_concat(list_transform(range(greatest(200 - len(ids), 0)), lambda i: 0),
  ids[greatest(len(ids) - 200, 0) + 1:]) AS ids FROM seq)""",
        ],
        "SELECT doc_id, CAST(len(ids) AS BIGINT) AS length, array_to_string(ids, ' ') AS ids FROM p",
    ),
    # With this vocabulary every later piece is one character, so a word is its longest
    # known beginning followed by single characters.
    "wordpiece": O.with_ctes(
        [
            *_INDEX,
            """letters AS (SELECT unnest(string_split('0123456789abcdefghijklmnopqrstuvwxyz', '')) AS ch,
  unnest(range(36)) AS i)""",
            """pieces AS (SELECT ch AS piece, 4 + i AS id FROM letters
  UNION ALL SELECT word, 75 + idx FROM idx WHERE length(word) >= 2)""",
            "vocab_words AS (SELECT DISTINCT word FROM t)",
            """heads AS (SELECT word, max(length(piece)) AS n, arg_max(id, length(piece)) AS id
  FROM (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda n: left(word, n))) AS piece FROM vocab_words)
  JOIN pieces USING (piece) GROUP BY word)""",
            """cut AS (SELECT word, CASE WHEN length(word) > 100 THEN [1] ELSE list_concat([id],
  list_transform(string_split(substring(word, n + 1), ''), lambda ch:
    40 + strpos('0123456789abcdefghijklmnopqrstuvwxyz', ch) - 1)) END AS ids FROM heads WHERE n < length(word)
  UNION ALL SELECT word, CASE WHEN length(word) > 100 THEN [1] ELSE [id] END FROM heads WHERE n = length(word))""",
            "flat AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM t JOIN cut USING (word) GROUP BY doc_id)",
            """e AS (SELECT c.doc_id, list_concat([2], coalesce(ids, [])[1:254], [3]) AS ids
  FROM c LEFT JOIN flat ON c.doc_id = flat.doc_id)""",
        ],
        """SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(256 - len(ids)), lambda i: 0)), ' ') AS input_ids,
  CAST(len(ids) AS BIGINT) AS n_real, CAST(256 AS BIGINT) AS length FROM e""",
    ),
}

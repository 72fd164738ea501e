"""The registered queries of the training-data operators, and the SQL they are checked against.

Each query runs one operator of this subpackage over its whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import (
    fim, langid, minhash, negatives, ordermin, packing, pieces, repeats, rollup, secrets, topk, toxicity, wordbpe,
)
from reviewlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashConfig(width=2))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_network(docs))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(table(spark, sf_dir, "documents"), model)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return packing.pack_tokens(table(spark, sf_dir, "documents"), model).withColumnRenamed("content", "ids")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, exact copies go, and documents cleaned of junk marks count anew; batch 1 is sent twice."""
    docs = table(spark, sf_dir, "documents")
    rollup_table = rollup.TokenRollup(spark, scratch_path(spark, "token-rollup"))
    rollup_table.commit(1, rollup.count_changes(docs), add_unnamed=True)
    first = docs.where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"))
    copies = docs.select("doc_id", "source", "lang", F.md5("text").alias("digest")).join(first, "digest")
    copies = copies.where("doc_id <> first").select("doc_id", "source", "lang", F.lit(None).cast("string").alias("text"))
    rollup_table.commit(2, rollup.count_changes(copies, delete=F.lit(True)))
    junk = "[%*&$#]{3}"
    cleaned = docs.where(F.col("text").rlike(junk)).withColumn("text", F.regexp_replace("text", junk, ""))
    kept = rollup_table.ledger().select("doc_id").distinct()
    rollup_table.commit(3, rollup.count_changes(cleaned.join(kept, "doc_id", "left_semi")))
    rollup_table.commit(1, rollup.count_changes(docs), add_unnamed=True)
    return rollup_table.totals()


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by seven go on by one, so that some close rows differ in label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return wordbpe.encode_documents(table(spark, sf_dir, "documents"), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_language_id": op4_language_id,
    "op5_piece_codec": op5_piece_codec,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_order_minhash": op7_order_minhash,
    "op8_block_topk": op8_block_topk,
    "op9_token_rollup": op9_token_rollup,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_word_bpe": op13_word_bpe,
}

# Queries without an entry can't be expressed in SQL; tests/llm compare them with brute force.
ORACLES: dict[str, str] = {
    "op1_minhash": """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
        ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS sh
    FROM w),
sizes AS (SELECT doc_id, len(sh) AS n, sh FROM s),
sets AS (SELECT min(doc_id) AS id, list_sort(sh) AS sh, n FROM sizes WHERE n > 0 GROUP BY list_sort(sh), n),
e AS (SELECT id, n, unnest(sh) AS g FROM sets),
links AS (
    SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
    SELECT id AS node, id AS root FROM sets
    UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node AND r.root < l.v),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, coalesce(roots.root, z.doc_id) AS component_id,
    coalesce(roots.root, z.doc_id) = z.doc_id AS kept
FROM sizes z LEFT JOIN sets ON sets.sh = list_sort(z.sh) LEFT JOIN roots ON roots.node = sets.id
""",
    "op2_substring_dedup": """
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words
    FROM documents),
wins AS (
    SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS s
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
twice AS (SELECT s FROM wins GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM wins SEMI JOIN twice USING (s)),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
stay AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stay USING (doc_id)
""",
    "op8_block_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op9_token_rollup": """
WITH firsts AS (SELECT md5(text) AS digest, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1),
kept AS (
    SELECT source, lang, regexp_replace(coalesce(text, ''), '[%*&$#]{3}', '', 'g') AS text
    FROM documents LEFT JOIN firsts ON digest = md5(text) WHERE first IS NULL OR first = doc_id),
counted AS (
    SELECT source, lang, 'space-1' AS version, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens FROM kept
    UNION ALL
    SELECT source, lang, 'mark-2',
        len(regexp_extract_all(text, '\\p{L}+|\\p{N}|[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]')) FROM kept)
SELECT source, lang, version, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, version
""",
    "op11_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
""",
    # Slices go by code points; group i of the hash is read as an integer.
    "op12_fill_in_middle": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (
    SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
    SELECT *, substring(text, 1, least(a, b)) AS pre, substring(text, least(a, b) + 1, abs(a - b)) AS mid,
        substring(text, greatest(a, b) + 1) AS suf FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
""",
}

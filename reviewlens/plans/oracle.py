"""Building blocks of the ANSI SQL each query is checked against."""

from __future__ import annotations

# Whitespace code points, in the notation of DuckDB's regular expressions.
WHITESPACE = (
    r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
MAX_FEATURES = 50_000
NUM_WORDS = 5_000

DOCS = "docs AS (SELECT d.doc_id, d.text, d.source, l.quality AS label, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def tags(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"


def entities(c: str) -> str:
    return rf"regexp_replace({c}, '&[a-zA-Z]+;|&#\d+;', ' ', 'g')"


def addresses(c: str) -> str:
    return rf"regexp_replace({c}, 'https?://[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+', '', 'g')"


def clean(c: str) -> str:
    return f"trim(regexp_replace(lower({addresses(entities(tags(c)))}), '[^a-z0-9]+', ' ', 'g'))"


def words(cleaned: str, shortest: int = 2) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda t: length(t) >= {shortest})"


def verdict(p: str) -> str:
    return f"CASE WHEN {p} > 0.5 THEN 'positive' ELSE 'negative' END"


def confidence(p: str) -> str:
    return f"CASE WHEN {p} > 0.5 THEN {p} ELSE 1.0 - {p} END"


def fixed(value: str, digits: int, unit: str = "", missing: str = "-") -> str:
    return (
        f"coalesce(CAST(CAST(round(CAST({value} AS DECIMAL(28,10)), {digits}) AS DECIMAL(28,{digits})) AS VARCHAR)"
        f" || '{unit}', '{missing}')"
    )


def percent(value: str) -> str:
    return fixed(f"CAST({value} AS DECIMAL(28,10)) * 100", 1, "%")


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def train_val(name: str, src: str) -> str:
    """src plus a split column: round(n / 10) rows of each class by seeded hash are val."""
    return f"""{name} AS (
  SELECT * EXCLUDE (rn, n), CASE WHEN rn <= round(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || doc_id), doc_id) AS rn,
               count(*) OVER (PARTITION BY label) AS n FROM {src}))"""


def three_parts(name: str, src: str) -> list[str]:
    """src plus train, val and test: the data's own test part, and validation cut from the rest."""
    return [
        f"{name}_rest AS (SELECT * FROM {src} WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) < 10)",
        train_val(f"{name}_tv", f"{name}_rest"),
        f"""{name} AS (SELECT * FROM {name}_tv UNION ALL
  SELECT *, 'test' AS split FROM {src} WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) >= 10)""",
    ]


def term_freq(name: str, src: str, keys: str = "doc_id", bigrams: bool = True) -> list[str]:
    """<name>_u: one row per text with its words; <name>_tf: (keys, term, tf)."""
    two = (
        f" UNION ALL SELECT {keys}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {name}_u"
        if bigrams else ""
    )
    return [
        f"{name}_c AS (SELECT *, {clean('text')} AS c FROM {src})",
        f"{name}_u AS (SELECT * EXCLUDE (text), {words('c')} AS w FROM {name}_c)",
        f"{name}_tf AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(w) AS term FROM {name}_u{two}) GROUP BY {keys}, term)",
    ]


def fit(name: str, src: str, bigrams: bool = True, k: int = MAX_FEATURES) -> list[str]:
    """<name>_m: (term, ctf, df, idf, coef) of the vocabulary of labelled texts."""
    return [
        *term_freq(name, src, bigrams=bigrams),
        f"{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(label), 0) AS DOUBLE) AS pos FROM {src})",
        f"""{name}_v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df, CAST(sum(label) AS BIGINT) AS df_pos
  FROM {name}_tf JOIN (SELECT doc_id, label FROM {src}) USING (doc_id)
  GROUP BY term ORDER BY ctf DESC, term LIMIT {k})""",
        f"""{name}_m AS (SELECT term, ctf, df, ln((1.0 + n) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf,
  ln((df_pos + 1) / (pos + 2.0)) - ln((df - df_pos + 1) / (n - pos + 2.0)) AS coef FROM {name}_v, {name}_n)""",
    ]


def score(name: str, model: str, src: str, keys: str = "doc_id", bigrams: bool = True) -> list[str]:
    """<name>: the rows of src (without text) plus c, w and p."""
    return [
        *term_freq(name, src, keys, bigrams),
        f"""{name}_z AS (SELECT {keys}, sum(x * coef) / sqrt(sum(x * x)) AS z
  FROM (SELECT {keys}, (1.0 + ln(CAST(tf AS DOUBLE))) * idf AS x, coef FROM {name}_tf JOIN {model}_m USING (term)) GROUP BY {keys})""",
        f"""{name} AS (SELECT u.*, CASE WHEN c = '' THEN CAST(0.5 AS DOUBLE)
    ELSE CAST(1.0 AS DOUBLE) / (1.0 + exp(-coalesce(z, 0.0))) END AS p
  FROM {name}_u u LEFT JOIN {name}_z USING ({keys}))""",
    ]


EVERY = "every AS (SELECT doc_id, text FROM documents)"


def scored_docs(src: str = "docs") -> list[str]:
    """scored: documents scored by the log-odds model fitted on the labelled ones; src is docs or every."""
    return [DOCS, EVERY, *fit("bi", "docs"), *score("scored", "bi", src)]


MODEL_NAMES = {
    "tfidf_bigram": "TF-IDF 1-2 grams",
    "tfidf_unigram": "TF-IDF unigrams",
    "class_prior": "Class prior",
}


def three_models(src: str = "docs") -> list[str]:
    """wide: doc_id, label (of docs only) and the score of three models fitted on the labelled documents."""
    label = "b.label, " if src == "docs" else ""
    return [
        *scored_docs(src),
        *fit("uni", "docs", bigrams=False),
        *score("scored_uni", "uni", src, bigrams=False),
        f"""wide AS (SELECT b.doc_id, {label}b.p AS p_tfidf_bigram, s.p AS p_tfidf_unigram,
  CASE WHEN b.c = '' THEN CAST(0.5 AS DOUBLE) ELSE (pos + 1) / (n + 2) END AS p_class_prior
  FROM scored b JOIN scored_uni s USING (doc_id), bi_n)""",
    ]


def long_models(src: str = "docs") -> list[str]:
    """long: one row per document and model."""
    label = "label, " if src == "docs" else ""
    return [
        *three_models(src),
        "long AS (" + " UNION ALL ".join(
            f"SELECT doc_id, {label}'{k}' AS model_key, '{n}' AS model_name, p_{k} AS p FROM wide"
            for k, n in MODEL_NAMES.items()
        ) + ")",
    ]


def confusion(src: str, by: str = "") -> str:
    """cm: confusion counts per group."""
    group, columns = (f" GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""cm AS (SELECT {columns}count(*) AS total,
  count(*) FILTER (CAST(p > 0.5 AS INTEGER) = label) AS correct,
  count(*) FILTER (p > 0.5 AND label = 1) AS tp, count(*) FILTER (p > 0.5 AND label = 0) AS fp,
  count(*) FILTER (NOT p > 0.5 AND label = 0) AS tn, count(*) FILTER (NOT p > 0.5 AND label = 1) AS fn
  FROM {src}{group})"""


ACCURACY = ratio("correct", "total")
PRECISION = ratio("tp", "tp + fp")
RECALL = ratio("tp", "tp + fn")
F1 = ratio(f"2.0 * {PRECISION} * {RECALL}", f"({PRECISION} + {RECALL})")
METRIC_COLUMNS = (
    f"round({ACCURACY}, 4) AS accuracy, round({PRECISION}, 4) AS precision, "
    f"round({RECALL}, 4) AS recall, round({F1}, 4) AS f1"
)

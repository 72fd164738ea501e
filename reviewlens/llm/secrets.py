"""Secret scans with a trigram index.

Each rule's expression is turned into a Boolean query of trigrams that every match must contain: letters
that follow each other give trigrams joined by AND, alternatives give OR, anything open gives nothing.
A block of texts is indexed by the trigrams that some query asks for (in lower case, over bytes), the
posting lists of a query are intersected and united, and the expression runs over the candidates only.
A rule whose query is empty, such as a run of hex digits, scans every text. The index of a block lives
beside its texts, so nothing is shuffled and a block is all that a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlens.llm.words import lower_ascii, slices, text_bytes

# Characters of a class that are spelled out as alternatives; a larger class counts as open.
CLASS_LIMIT = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1  # least length of the checked group
    group: int = 0


# The three kinds that results must have. The rest are further kinds of this operator.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
RULES = (
    *BASE_RULES,
    Rule("key_block", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.-]{1,64}:[^\s@/]{3,64}@"),
)

# A query: a string is a trigram, ("and" | "or", parts) combines, None asks for nothing.
Query = str | tuple[str, tuple] | None


def combine(how: str, parts: list[Query]) -> Query:
    """AND leaves out parts that ask for nothing; one such alternative makes an OR ask for nothing."""
    if how == "or" and None in parts:
        return None
    parts = list(dict.fromkeys(x for x in parts if x is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (how, tuple(parts))


def spelled(text: str) -> Query:
    data = text.encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)})
    return combine("and", [data[i: i + 3] for i in range(len(data) - 2)])


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case and over bytes, that every match of a regular expression contains."""
    return of_sequence(syntax.parse(pattern))


def of_sequence(nodes) -> Query:
    """Literal neighbours are spelled on together, with small classes and fixed alternatives multiplied out."""
    found: list[Query] = []
    runs = [""]

    def flush() -> None:
        nonlocal runs
        found.append(combine("or", [spelled(x) for x in runs]))
        runs = [""]

    for op, value in nodes:
        texts = exact(op, value)
        if texts and len(runs) * len(texts) <= 64:
            runs = [a + b for a in runs for b in texts]
            continue
        flush()
        if op is syntax.SUBPATTERN:
            found.append(of_sequence(value[3]))
        elif op is syntax.BRANCH:
            found.append(combine("or", [of_sequence(x) for x in value[1]]))
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] >= 1:
            found.append(of_sequence(value[2]))
    flush()
    return combine("and", found)


def exact(op, value) -> list[str] | None:
    """All texts that a node can match, if they are few."""
    if op is syntax.LITERAL:
        return [chr(value)]
    if op is syntax.IN:
        if any(kind is not syntax.LITERAL for kind, _ in value) or len(value) > CLASS_LIMIT:
            return None
        return [chr(c) for _, c in value]
    if op is syntax.SUBPATTERN:
        return product(value[3])
    if op is syntax.BRANCH:
        each = [product(x) for x in value[1]]
        return None if None in each else [x for texts in each for x in texts]
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[1] == 1:
        inner = product(value[2])
        return None if inner is None else inner if value[0] else ["", *inner]
    return None


def product(nodes) -> list[str] | None:
    runs = [""]
    for op, value in nodes:
        texts = exact(op, value)
        if texts is None or len(runs) * len(texts) > 64:
            return None
        runs = [a + b for a in runs for b in texts]
    return runs


def trigrams_in(query: Query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} - {None}
    return set().union(*map(trigrams_in, query[1]))


class TrigramIndex:
    """Posting lists of one block of texts for the trigrams asked for."""

    def __init__(self, wanted: list[str]) -> None:
        self.place = {t: i + 1 for i, t in enumerate(wanted)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for t, i in self.place.items():
            a, b, c = t.encode("latin-1")
            self.slot[a << 16 | b << 8 | c] = i

    def build(self, data: np.ndarray, at: np.ndarray) -> None:
        self.rows = len(at) - 1
        wide = lower_ascii(data).astype(np.int32)
        slots = self.slot[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]] if len(data) > 2 else self.slot[:0]
        where = np.flatnonzero(slots)
        row = np.searchsorted(at, where, "right") - 1
        inside = where + 3 <= at[row + 1]
        pairs = np.unique(slots[where[inside]].astype(np.int64) * self.rows + row[inside]) if self.rows else where
        self.starts = np.searchsorted(pairs, np.arange(len(self.place) + 2) * self.rows)
        self.postings = pairs % max(self.rows, 1)

    def posting(self, trigram: str) -> np.ndarray:
        i = self.place[trigram]
        return self.postings[self.starts[i]: self.starts[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Rows, in order, that can hold a match."""
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.posting(query)
        lists = sorted((self.candidates(x) for x in query[1]), key=len)
        rows = lists[0]
        for other in lists[1:]:
            if query[0] == "and" and not len(rows):
                break
            merge = np.intersect1d if query[0] == "and" else np.union1d
            rows = merge(rows, other)
        return rows


def scanner(rules: tuple[Rule, ...]) -> callable:
    """A function from a block of texts to (rule number, start, end) spans by row."""
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(sorted(set().union(*map(trigrams_in, queries))))

    def scan(part: pa.RecordBatch) -> tuple[list[str], dict[int, list[tuple[int, int, int]]]]:
        texts = [t or "" for t in part.column("text").to_pylist()]
        index.build(*text_bytes(part.column("text")))
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for n, rule in enumerate(rules):
            for row in index.candidates(queries[n]).tolist():
                for m in compiled[n].finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans.setdefault(row, []).append((m.start(), n, m.end()))
        for found in spans.values():
            found.sort()
        return texts, spans
    return scan


def scan_batches(rules: tuple[Rule, ...]) -> callable:
    base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                spans = scan(part)[1]
                counts, digests, listed = [], [], []
                for row in range(part.num_rows):
                    found = spans.get(row, [])
                    shown = [(n, f"{rules[n].kind}:{a}:{b}") for a, n, b in found]
                    counts.append([sum(n == k for n, _ in shown) for k in range(base)])
                    digests.append(hashlib.sha256(",".join(x for n, x in shown if n < base).encode()).hexdigest())
                    listed.append(",".join(x for _, x in shown))
                by_kind = [pa.array(x, pa.int64()) for x in zip(*counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *by_kind, pa.array(digests), pa.array(listed)],
                    ["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])
    return run


def scan_documents(docs: DataFrame, more: tuple[Rule, ...] = RULES[len(BASE_RULES):]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, by start, then kind).

    Matches of a kind are leftmost and don't overlap; those that are too short are dropped. ``more`` are
    rules beside the base ones; their spans appear in ``spans`` only. One narrow pass. A null text counts as
    empty; a null or repeated doc_id is passed through; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{r.kind} bigint" for r in BASE_RULES)
    return docs.select("doc_id", "text").mapInArrow(
        scan_batches((*BASE_RULES, *more)), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def mask_batches(rules: tuple[Rule, ...], mask: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                texts, spans = scan(part)
                masked = part.column("text").to_pylist()
                for row, found in spans.items():
                    out, done = [], 0
                    for a, _, b in found:
                        if a >= done:
                            out += [texts[row][done:a], mask]
                        done = max(done, b)
                    masked[row] = "".join(out) + texts[row][done:]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, "text", pa.array(masked, part.schema.field(at).type))
    return run


def mask_secrets(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of a secret in ``text`` replaced; overlapping spans become one mask.

    All columns, whatever their names, and rows are kept; null texts stay null.
    """
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(mask_batches(rules, mask), plain.schema).toDF(*docs.columns)

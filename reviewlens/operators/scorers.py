"""Pluggable scorers: any object with name, load and predict runs over Arrow batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.decision import prediction, softmax2_positive
from reviewlens.functions.text import clean
from reviewlens.operators.tfidf import LinearModel
from reviewlens.operators.wordpiece import encode


class Scorer(Protocol):
    name: str

    def load(self) -> None:
        """Called once per task, before the first batch."""

    def predict(self, cleaned: pd.Series) -> np.ndarray:
        """P(positive) for a batch of cleaned, non-empty texts."""


# Characters of text that a scorer is handed at a time; a longer text comes alone.
PART_CHARS = 1 << 18


def text_parts(texts: pd.Series) -> list[np.ndarray]:
    """Places of the texts that are not empty, in runs of at most PART_CHARS characters or of one text."""
    size = texts.str.len().to_numpy(dtype=np.int64)
    parts, part, held = [], [], 0
    for place in np.flatnonzero(size):
        if part and held + size[place] > PART_CHARS:
            parts.append(np.array(part))
            part, held = [], 0
        part.append(place)
        held += size[place]
    return [*parts, np.array(part)] if part else parts


def text_runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most PART_CHARS bytes of text, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + PART_CHARS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def score_texts(docs: DataFrame, keys: list[str], text: str, scorer: Scorer) -> DataFrame:
    """(keys, model_name, p_pos, latency_ms). No shuffle and no state, so it serves streams too.

    Empty text is not handed to the scorer: it gets 0.5 and no latency. Rows arrive in batches of a number of
    rows; only runs of some PART_CHARS characters at a time become Python strings and go to the scorer, so its
    memory does not depend on how long the texts are. The latency of a text is its part's time divided by the
    texts in it.
    """
    cleaned = docs.select(*keys, clean(F.col(text)).alias("_clean"))
    schema = ", ".join(
        [f"`{k}` {cleaned.schema[k].dataType.simpleString()}" for k in keys]
        + ["model_name string", "p_pos double", "latency_ms double"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.load()
        for batch in (part for whole in batches for part in text_runs(whole, "_clean")):
            texts = batch.column("_clean").to_pandas()
            p = np.full(len(texts), 0.5)
            latency = np.zeros(len(texts))
            for part in text_parts(texts):
                start = time.perf_counter()
                p[part] = scorer.predict(texts.iloc[part])
                latency[part] = (time.perf_counter() - start) * 1000 / len(part)
            names = pa.array([scorer.name] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), names, pa.array(p), pa.array(latency)],
                [*keys, "model_name", "p_pos", "latency_ms"])

    return cleaned.mapInArrow(run, schema)


def with_prediction_record(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prediction", prediction(F.col("p_pos"), F.col("latency_ms")))


# Models that a Python worker has built, by token; two at most.
_LOADED: dict[str, tuple] = {}


@dataclass
class LinearScorer:
    """A linear model applied to a batch of texts without grouping rows.

    For calls that cannot group a document's words. Workers get
    the terms as one broadcast, whose size the vocabulary limit bounds. Words become
    numbers once; an n-gram is then a pair (its first n - 1 words, its last word), looked up
    for all texts of the batch together.
    """

    shared: Any
    intercept: float
    ngram_range: tuple[int, int]
    name: str = "TF-IDF + Logistic Regression"
    token: str = ""  # names the model in a worker that keeps it between tasks
    _words: dict[str, int] = field(default_factory=dict, repr=False)
    _terms: list[np.ndarray] = field(default_factory=list, repr=False)
    _pairs: list[np.ndarray] = field(default_factory=list, repr=False)
    _values: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def of(cls, model: LinearModel) -> LinearScorer:
        """At most ``max_features`` terms go to the workers; score with ``tfidf.score`` where that is too many."""
        vocab = model.vocab
        terms = [tuple(r) for r in vocab.table.select("term", "idf", "coef").collect()]
        shared = vocab.table.sparkSession.sparkContext.broadcast(terms)
        return cls(shared, float(model.intercept), vocab.ngram_range, token=uuid.uuid4().hex)

    def load(self) -> None:
        """Number words and n-grams: per length, sorted pairs and the term each stands for, if any."""
        kept = _LOADED.get(self.token)
        if kept is not None:
            self._values, self._words, self._pairs, self._terms = kept
            return
        rows = self.shared.value
        self._values = np.array([(idf, coef) for _, idf, coef in rows], dtype=float).reshape(-1, 2)
        split = [tuple(term.split(" ")) for term, _, _ in rows]
        self._words = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
        term_of = {words: i for i, words in enumerate(split)}
        number = {(w,): i for w, i in self._words.items()}
        self._pairs, self._terms = [], [np.array([term_of.get((w,), -1) for w in self._words], dtype=np.int64)]
        for n in range(2, self.ngram_range[1] + 1):
            # Beginnings of longer terms count too, even if they are no terms themselves.
            grams = {words[:n] for words in split if len(words) >= n}
            keyed = sorted((number[g[:-1]] * len(self._words) + self._words[g[-1]], g) for g in grams if g[:-1] in number)
            number = {g: i for i, (_, g) in enumerate(keyed)}
            self._pairs.append(np.array([k for k, _ in keyed], dtype=np.int64))
            self._terms.append(np.array([term_of.get(g, -1) for _, g in keyed], dtype=np.int64))
        if self.token:
            while len(_LOADED) >= 2:
                _LOADED.pop(next(iter(_LOADED)))
            _LOADED[self.token] = (self._values, self._words, self._pairs, self._terms)

    def _found(self, cleaned: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Row and term number of every occurrence of a known term."""
        texts = [[w for w in s.split(" ") if len(w) >= 2] for s in cleaned]
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        word = np.fromiter((self._words.get(w, -1) for t in texts for w in t), np.int64, len(rows))
        gram, at, hits = word, np.arange(len(word)), []
        for n, terms in enumerate(self._terms, start=1):
            if n > 1:
                # Extend by the next word, if it belongs to the same text.
                inside = at + 1 < len(word)
                gram, at, begin = gram[inside], at[inside] + 1, begin[inside]
                together = (rows[at] == rows[begin]) & (word[at] >= 0)
                gram, at, begin = gram[together], at[together], begin[together]
                key, pairs = gram * len(self._words) + word[at], self._pairs[n - 2]
                place = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
                known = pairs[place] == key if len(pairs) else np.zeros(len(key), bool)
                gram, at, begin = place[known], at[known], begin[known]
            else:
                known = gram >= 0
                gram, at = gram[known], at[known]
                begin = at
            if n >= self.ngram_range[0]:
                term = terms[gram] if len(terms) else gram
                hits.append(np.stack([rows[begin][term >= 0], term[term >= 0]]))
        return tuple(np.concatenate(hits, axis=1)) if hits else (rows[:0], rows[:0])

    def predict(self, cleaned: pd.Series) -> np.ndarray:
        row, term = self._found(cleaned)
        size = max(len(self._values), 1)
        pair, tf = np.unique(row * size + term, return_counts=True)
        row, term = pair // size, pair % size
        weight = (1.0 + np.log(tf)) * self._values[term, 0]
        dot = np.bincount(row, weight * self._values[term, 1], len(cleaned))
        norm = np.sqrt(np.bincount(row, weight * weight, len(cleaned)))
        z = self.intercept + np.divide(dot, norm, out=np.zeros(len(cleaned)), where=norm > 0)
        return 1.0 / (1.0 + np.exp(-z))


class Session(Protocol):
    def run(self, outputs: list[str] | None, inputs: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Logits [n, 2], negative first, as the first output."""


def onnx_session(model_path: str) -> Callable[[], Session]:
    """A factory that opens the model in the worker with all graph optimisations on."""
    def open_session() -> Session:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
        return ort.InferenceSession(model_path, options)

    return open_session


def score_logits(
    docs: DataFrame,
    keys: list[str],
    text: str,
    vocabulary: DataFrame,
    max_length: int,
    open_session: Callable[[], Session],
) -> DataFrame:
    """(keys, empty, logit_neg, logit_pos, p_pos) from WordPiece ids through a session per task."""
    encoded = encode(docs, keys, text, vocabulary, max_length)
    schema = ", ".join(
        [f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keys]
        + ["empty boolean", "logit_neg double", "logit_pos double"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = open_session()
        for batch in batches:
            if batch.empty:
                continue
            inputs = {
                name: np.stack(batch[name].to_numpy()).astype(np.int64) for name in ("input_ids", "attention_mask")
            }
            logits = np.asarray(session.run(None, inputs)[0], dtype=float)
            yield batch[[*keys, "empty"]].assign(logit_neg=logits[:, 0], logit_pos=logits[:, 1])

    p = softmax2_positive(F.col("logit_neg"), F.col("logit_pos"))
    return encoded.mapInPandas(run, schema).withColumn("p_pos", F.when(F.col("empty"), 0.5).otherwise(p))

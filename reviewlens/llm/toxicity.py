"""Toxicity by a classifier chain over word and stem features.

Categories are predicted one after the other. Each is a logistic regression on the same text features and
on the probabilities of the categories before it. For training these come from models that did not see
the row (out of fold), so a later model learns from earlier predictions as good as it will meet.

Features of a document are the hashes of its words, of the words' first 4, 5 and 6 bytes (stems, for
languages that add endings) and of its runs of marks; what counts is whether one occurs. They are 64-bit
hashes, not buckets, so unrelated words don't share a weight. A category keeps the features most
associated with it (chi-square) on the labelled sample.

The fit uses a bounded sample of labelled rows (``sample_rows``, drawn by a hash of doc_id). Feature counts
are summed by tasks; the driver gets the bounded sample's chosen features only and fits in numpy. Prediction
reads every word of every text in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.sampling import smallest_hashes
from reviewlens.llm.words import IS_SPACE, find_words, hash_spans, lower_ascii, slices, text_bytes
from reviewlens.session import materialise

IS_MARK = np.zeros(256, bool)
IS_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityConfig:
    # Ordered categories: name and SQL condition over the label columns.
    categories: tuple[tuple[str, str], ...] = (
        ("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_fluent", "toxic = 1 AND quality = 1"))
    verdict: str = "toxic"  # the category that rejects a document
    threshold: float = 0.5
    sample_rows: int = 12_000  # labelled rows used for the fit, at most
    features: int = 400  # features kept per category, at most
    least_documents: int = 3  # a kept feature occurs in so many sampled documents
    folds: int = 5
    l2: float = 1e-3
    steps: int = 60


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature hashes of each text, sorted."""
    data, at = text_bytes(texts)
    data = lower_ascii(data)
    words = np.where(IS_MARK[data], np.uint8(32), data)
    marks = np.where(IS_MARK[data] | IS_SPACE[data], data, np.uint8(32))
    found = []
    starts, ends, first = find_words(words, at)
    found.append((first, hash_spans(words, starts, ends)))
    for stem in STEMS:
        long = ends - starts > stem
        cut = np.concatenate(([0], np.cumsum(long)))[first]
        found.append((cut, hash_spans(words, starts[long], starts[long] + stem) ^ np.uint64(stem)))
    starts, ends, first = find_words(marks, at)
    found.append((first, hash_spans(marks, starts, ends)))
    for i in range(len(at) - 1):
        yield np.unique(np.concatenate([h[f[i]: f[i + 1]] for f, h in found]))


@dataclass
class Chain:
    """Fitted models: per category the features' weights, those of earlier probabilities, and the intercept."""

    names: list[str]
    vocabulary: np.ndarray  # sorted hashes
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def lookup(self, own: np.ndarray) -> np.ndarray:
        """Places in the vocabulary of the features that a document has."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, own)
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == own]

    def predict(self, places: np.ndarray) -> list[float]:
        found: list[float] = []
        for w, e, b in zip(self.weights, self.earlier, self.intercepts):
            z = b + w[places].sum() + float(np.dot(e, found))
            found.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return found


class Rows:
    """A sparse 0/1 matrix as index arrays, with dense columns beside it."""

    def __init__(self, places: list[np.ndarray], width: int, dense: np.ndarray) -> None:
        self.row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        self.column = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.width, self.dense, self.n = width, dense, len(places)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + self.dense @ w[self.width:-1] + w[-1]

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.column, r[self.row], self.width), self.dense.T @ r, [r.sum()]))


def logistic(rows: Rows, y: np.ndarray, use: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Regularised logistic regression on the rows in ``use`` by Newton steps with conjugate gradients."""
    total = max(use.sum(), 1.0)
    w = np.zeros(rows.width + rows.dense.shape[1] + 1)
    ridge = np.full(len(w), config.l2)
    ridge[-1] = 1e-9
    rate = np.clip((y * use).sum() / total, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(config.steps):
        p = 1 / (1 + np.exp(-np.clip(rows.times(w), -30, 30)))
        gradient = rows.transposed(use * (p - y)) / total + ridge * w
        if np.abs(gradient).max() < 1e-6:
            break
        curve = use * p * (1 - p) / total + 1e-12
        step, left = np.zeros(len(w)), -gradient
        way, size = left.copy(), left @ left
        for _ in range(30):
            bent = rows.transposed(curve * rows.times(way)) + ridge * way
            by = size / max(way @ bent, 1e-30)
            step, left = step + by * way, left - by * bent
            new = left @ left
            if new < 1e-16:
                break
            way, size = left + new / size * way, new
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return w


def count_batches(names: list[str]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(feature_sets(part.column("text")))
                feature, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                columns = [np.bincount(inverse, minlength=len(feature))]
                for name in names:
                    flag = part.column(name).to_numpy(zero_copy_only=False).astype(float)
                    columns.append(np.bincount(inverse, flag[owner], len(feature)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)],
                    ["feature", "n", *(f"n_{i}" for i in range(len(names)))])
    return run


def place_batches(vocabulary: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain([], vocabulary)
        for batch in batches:
            for part in slices(batch):
                places = [chain.lookup(own) for own in feature_sets(part.column("text"))]
                others = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in others), pa.array(places, pa.list_(pa.int64()))], [*others, "places"])
    return run


def fit_chain(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Chain:
    """Fit on labelled documents; rows with a null text, doc_id or category are left out.

    A document labelled more than once counts for each category if any of its labels does.
    """
    names = [n for n, _ in config.categories]
    flags = labels.where("doc_id IS NOT NULL").select("doc_id", *(F.expr(c).cast("int").alias(n) for n, c in config.categories))
    flags = flags.dropna().groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    # Ids first: which rows are sampled is known before any text is read. sample_rows bounds the broadcast.
    ids = flags.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    ids = materialise(ids.join(F.broadcast(smallest_hashes(ids, "doc_id", config.sample_rows)), "doc_id", "left_semi"))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    # One text of a doc_id that is repeated, so that sample_rows bounds what the driver gets as well.
    sample = sample.groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    sample = materialise(sample.repartition(max(1, min(24, ids.count() // 250)), "doc_id"))
    total = sample.count()
    counts_schema = "feature bigint, n bigint, " + ", ".join(f"n_{i} bigint" for i in range(len(names)))
    counts = sample.select("text", *names).mapInArrow(count_batches(names), counts_schema).groupBy("feature").agg(
        F.sum("n").alias("n"), *(F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(names))))
    counts = materialise(counts.where(F.col("n") >= config.least_documents))
    chosen: set[int] = set()
    for i, name in enumerate(names):
        positive = sample.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]
        if not 0 < positive < total:
            continue
        # Chi-square of a 2 x 2 table, up to a factor.
        hit, n = F.col(f"n_{i}").cast("double"), F.col("n").cast("double")
        chi = F.pow(hit * total - n * positive, 2) / (n * F.greatest(total - n, F.lit(0.5)))
        best = counts.orderBy(chi.desc(), "feature").limit(config.features).select("feature").collect()
        chosen |= {r["feature"] for r in best}
    vocabulary = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))
    columns = ", ".join(f"{n} int" for n in names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", *names, "text").mapInArrow(
        place_batches(vocabulary), f"doc_id {kind}, {columns}, places array<bigint>")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(config.folds)))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most sample_rows
    return fit_rows([np.array(r["places"], np.int64) for r in rows], np.array([[r[n] for n in names] for r in rows], float),
                    np.array([r["fold"] for r in rows]), names, vocabulary, config)


def fit_rows(places: list[np.ndarray], y: np.ndarray, fold: np.ndarray, names: list[str], vocabulary: np.ndarray,
             config: ToxicityConfig) -> Chain:
    chain = Chain(names, vocabulary)
    width, n = len(vocabulary), len(places)
    earlier = np.zeros((n, 0))
    for i in range(len(names)):
        if n == 0 or y[:, i].min() == y[:, i].max():
            # One class only: its share is all there is to know.
            z = 0.0 if n == 0 else float(y[0, i])
            chain.weights.append(np.zeros(width))
            chain.earlier.append(np.zeros(i))
            chain.intercepts.append(30.0 if z else -30.0)
            out_of_fold = np.full(n, z)
        else:
            rows = Rows(places, width, earlier)
            w = logistic(rows, y[:, i], np.ones(n), config)
            chain.weights.append(w[:width])
            chain.earlier.append(w[width:-1])
            chain.intercepts.append(float(w[-1]))
            out_of_fold = np.zeros(n)
            for k in range(config.folds):
                held = fold == k
                if held.any():
                    z = rows.times(logistic(rows, y[:, i], (~held).astype(float), config))
                    out_of_fold[held] = 1 / (1 + np.exp(-np.clip(z[held], -30, 30)))
        earlier = np.column_stack((earlier, out_of_fold))
    return chain


def predict_batches(chain: Chain, config: ToxicityConfig) -> callable:
    verdict = chain.names.index(config.verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([chain.predict(chain.lookup(own)) for own in feature_sets(part.column("text"))])
                found = found.reshape(part.num_rows, len(chain.names))
                others = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in others), *(pa.array(found[:, i]) for i in range(len(chain.names))),
                     pa.array(found[:, verdict] >= config.threshold)],
                    [*others, *(f"p_{n}" for n in chain.names), "rejected"])
    return run


def predict(docs: DataFrame, chain: Chain, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, p_<category> for each category in chain order, rejected. One narrow pass over whole texts.

    A null or empty text has no features, so its probabilities follow the intercepts. A null or repeated doc_id
    is passed through; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"p_{n} double" for n in chain.names)
    return docs.select("doc_id", "text").mapInArrow(
        predict_batches(chain, config), f"doc_id {kind}, {columns}, rejected boolean")


def accept_batches(chain: Chain, config: ToxicityConfig) -> callable:
    verdict = chain.names.index(config.verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = feature_sets(part.column("text"))
                keep = [chain.predict(chain.lookup(own))[verdict] < config.threshold for own in sets]
                yield part.filter(pa.array(keep, pa.bool_()))
    return run


def accepted(docs: DataFrame, chain: Chain, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of docs, all columns whatever their names, that the chain's verdict does not reject."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(accept_batches(chain, config), plain.schema).toDF(*docs.columns)

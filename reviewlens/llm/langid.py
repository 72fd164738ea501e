"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``window`` bytes. In each window one gated recurrent unit reads forwards and one
backwards; a byte acts through a learned row of inputs to the gates. At every position the two states give
probabilities of the languages, so every byte is labelled; a document's probabilities are the mean over all
its positions. The network is trained here, in numpy, by backpropagation through time with Adam, on the
cross-entropy at every position.

Training takes windows of a bounded sample (``per_language`` documents of each language, drawn by a hash of
doc_id, and ``windows_each`` windows of each); prediction reads every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.sampling import smallest_hashes
from reviewlens.llm.words import slices, text_bytes
from reviewlens.session import materialise

UNDECIDED = "und"
_candidates = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; number characters such as ½ and Ⅷ, which the pattern lets through, are none."""
    return any(m.group().isalpha() for m in _candidates(text or ""))


@dataclass(frozen=True)
class LangConfig:
    window: int = 64
    hidden: int = 8
    per_language: int = 400  # sampled documents of a language, at most
    most_languages: int = 256  # languages that are learned, those with the most sampled documents
    windows_each: int = 4  # training windows of a sampled document, at most
    steps: int = 240
    batch: int = 192
    rate: float = 0.03
    seed: int = 11
    block: int = 4096  # windows that go through the network together


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class ByteGRU:
    """Parameters by name: for each direction ``in`` (256 x 3H gate inputs) and ``rec`` (H x 3H), then ``out`` and ``bias``."""

    def __init__(self, languages: list[str], config: LangConfig) -> None:
        random = np.random.Generator(np.random.PCG64(config.seed))
        h, c = config.hidden, len(languages)
        self.languages, self.hidden, self.config = languages, h, config
        self.params = {}
        for way in ("f", "b"):
            self.params[f"in_{way}"] = random.normal(0, 0.4, (256, 3 * h))
            self.params[f"rec_{way}"] = random.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.params["out"] = random.normal(0, 1 / np.sqrt(2 * h), (2 * h, c))
        self.params["bias"] = np.zeros(c)
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def states(self, data: np.ndarray, way: str, live: np.ndarray | None, keep: bool):
        """States after each byte (time first); with ``keep`` also the gates that the way back needs.

        Where ``live`` is 0 the state is held at zero, so a short window reads as if it stood alone.
        """
        h, (n, steps) = self.hidden, data.shape
        inputs, rec = self.params[f"in_{way}"], self.params[f"rec_{way}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((steps, n, h), np.float32)
        trace = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x = inputs[data[:, t]]
            past = state @ rec
            gates = sigmoid(x[:, : 2 * h] + past[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            fresh = np.tanh(x[:, 2 * h:] + reset * past[:, 2 * h:])
            new = fresh + update * (state - fresh)
            if live is not None:
                new *= live[:, t, None]
            if keep:
                trace.append((t, state, update, reset, fresh, past[:, 2 * h:]))
            out[t] = state = new
        return out, trace

    def position_probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        h = self.hidden
        z = forward @ self.params["out"][:h] + backward @ self.params["out"][h:] + self.params["bias"]
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=-1, keepdims=True)

    def read(self, data: np.ndarray, way: str, live: np.ndarray | None) -> np.ndarray:
        """The same states as ``states`` gives, laid out time x hidden x window: the layout that reads fastest."""
        h, (n, steps) = self.hidden, data.shape
        half = np.concatenate((np.full(2 * h, 0.5), np.ones(h))).astype(np.float32)  # of the sigmoid by tanh
        inputs = np.ascontiguousarray((self.params[f"in_{way}"] * half).T)
        rec = np.ascontiguousarray((self.params[f"rec_{way}"] * half).T)
        at = np.ascontiguousarray(data.T).astype(np.intp)
        state, out = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32)
        x, past = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        gates, update, reset, fresh = x[: 2 * h], x[:h], x[h: 2 * h], past[2 * h:]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.take(inputs, at[t], axis=1, out=x, mode="clip")
            np.matmul(rec, state, out=past)
            gates += past[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            fresh *= reset
            fresh += x[2 * h:]
            np.tanh(fresh, out=fresh)
            np.subtract(state, fresh, out=out[t])
            state = out[t]
            state *= update
            state += fresh
            if live is not None:
                state *= live[:, t]
        return out

    def window_sums(self, data: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Summed probabilities over the positions of each window (n x languages)."""
        h, weights = self.hidden, np.ascontiguousarray(self.params["out"].T)
        z = np.matmul(weights[:, :h], self.read(data, "f", live))
        z += np.matmul(weights[:, h:], self.read(data, "b", live))
        z += self.params["bias"][:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        if live is not None:
            z *= live.T[:, None, :]
        return z.sum(axis=0).T

    def gradients(self, data: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean loss over live positions, and its gradients by backpropagation through time."""
        h = self.hidden
        runs = {way: self.states(data, way, live, True) for way in ("f", "b")}
        p = self.position_probabilities(runs["f"][0], runs["b"][0])
        count = live.sum()
        rows = np.arange(len(label))
        loss = -(np.log(p[:, rows, label] + 1e-9) * live.T).sum() / count
        d = p
        d[:, rows, label] -= 1
        d *= (live.T / count)[:, :, None]
        grads = {"bias": d.sum(axis=(0, 1)), "out": np.concatenate(
            [np.tensordot(runs[w][0], d, ((0, 1), (0, 1))) for w in ("f", "b")])}
        for i, way in enumerate(("f", "b")):
            inputs, rec = np.zeros((256, 3 * h), np.float32), np.zeros((h, 3 * h), np.float32)
            weights = self.params[f"rec_{way}"]
            above = d @ self.params["out"][i * h: (i + 1) * h].T
            carried = np.zeros((len(label), h), np.float32)
            for t, state, update, reset, fresh, past in reversed(runs[way][1]):
                new = (above[t] + carried) * live[:, t, None]
                d_fresh = new * (1 - update) * (1 - fresh * fresh)
                d_update = new * (state - fresh) * update * (1 - update)
                d_reset = d_fresh * past * reset * (1 - reset)
                into = np.concatenate((d_update, d_reset, d_fresh), axis=1)
                back = np.concatenate((d_update, d_reset, d_fresh * reset), axis=1)
                np.add.at(inputs, data[:, t], into)
                rec += state.T @ back
                carried = new * update + back @ weights.T
            grads[f"in_{way}"], grads[f"rec_{way}"] = inputs, rec
        return float(loss), grads

    def fit(self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> list[float]:
        """Adam over batches that take the languages evenly; returns the losses."""
        config = self.config
        random = np.random.Generator(np.random.PCG64(config.seed + 1))
        live = (np.arange(data.shape[1]) < lengths[:, None]).astype(np.float32)
        by_label = [np.flatnonzero(label == c) for c in range(len(self.languages))]
        by_label = [x for x in by_label if len(x)]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        for step in range(1, config.steps + 1):
            each = max(1, config.batch // len(by_label))
            take = np.concatenate([random.choice(x, each) for x in by_label])
            loss, grads = self.gradients(data[take], live[take], label[take])
            losses.append(loss)
            rate = config.rate * (1 - (step - 1) / config.steps)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                fixed = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                self.params[k] = (self.params[k] - rate * fixed).astype(np.float32)
        return losses

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text; texts end to end in ``data``, begins in ``at``."""
        width, block = self.config.window, self.config.block
        sizes = np.diff(at)
        total = np.zeros((len(sizes), len(self.languages)))
        whole = sizes // width
        owner = np.repeat(np.arange(len(sizes)), whole)
        begin = at[:-1][owner] + width * (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole))
        span = np.arange(width)
        for i in range(0, len(owner), block):
            sums = self.window_sums(data[begin[i: i + block, None] + span])
            np.add.at(total, owner[i: i + block], sums)
        rest = sizes - whole * width
        owner = np.flatnonzero(rest)
        for i in range(0, len(owner), block):
            own = owner[i: i + block]
            left = (at[1:] - rest)[own, None] + span
            live = (span < rest[own, None]).astype(np.float32)
            sums = self.window_sums(data[np.minimum(left, len(data) - 1)], live)
            total[own] += sums
        return total / np.maximum(sizes, 1)[:, None]


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def window_rows(config: LangConfig) -> callable:
    """A few windows of each sampled text, at places drawn from its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                count = min(config.windows_each, -(-len(raw) // config.window))
                random = np.random.Generator(np.random.PCG64(len(raw)))
                for _ in range(count):
                    begin = int(random.integers(0, max(1, len(raw) - config.window + 1)))
                    langs.append(lang)
                    pieces.append(raw[begin: begin + config.window])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "piece"])
    return run


def fit_network(docs: DataFrame, config: LangConfig = LangConfig()) -> ByteGRU | None:
    """Train on documents that are not held out and have a text and a language; None if there are none."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    ids = smallest_hashes(known, "doc_id", config.per_language, by="lang")
    most = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.most_languages)
    # per_language documents of most_languages languages bound this broadcast and what the driver gets: a
    # doc_id that is repeated gives one text for each of its languages.
    ids = materialise(ids.join(most.select("lang"), "lang", "left_semi"))
    pieces = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    pieces = pieces.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    rows = pieces.mapInArrow(window_rows(config), "lang string, piece binary").collect()
    rows = sorted((r["lang"], bytes(r["piece"])) for r in rows if len(r["piece"]))
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    data = np.zeros((len(rows), config.window), np.uint8)
    for i, (_, piece) in enumerate(rows):
        data[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    network = ByteGRU(languages, config)
    network.fit(data, np.array([len(p) for _, p in rows]), np.array([languages.index(lang) for lang, _ in rows]))
    return network


def label_batches(network: ByteGRU | None) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(map(has_letter, part.column("text").to_pylist()))
                langs, scores = [UNDECIDED] * len(found), np.zeros(len(found))
                if network is not None:
                    p = network.probabilities(*text_bytes(part.column("text")))
                    best = p.argmax(axis=1)
                    langs = [network.languages[b] if ok else UNDECIDED for b, ok in zip(best.tolist(), found)]
                    scores = np.where(found, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, network: ByteGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; one narrow pass over whole texts.

    A null text, one without a letter, or any text where nothing could be learned is ``und`` with score 0. A null
    or repeated doc_id is passed through; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        label_batches(network), f"doc_id {kind}, held_out boolean, lang_pred string, score double")

"""Order MinHash fingerprints of whole documents.

Every run of ``k`` code points is numbered by how often it has occurred before in its text. Each of the
``size`` hash functions picks the ``take`` numbered runs with the least hashes, puts them back in text
order, and hashes that tuple. Two texts share a component when their least runs are the same and stand in
the same order, so unlike a set sketch the share of equal components falls with the edit distance.

Neighbours in doc_id order are found without ordering the table in one place: doc_id is cut into ranges
at approximate quantiles, each range is sorted by itself and streamed with one row held back, and the
first row of each range is also sent to the end of the range before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.words import mix, powers_of

_POINT_BASE = 0xD1342543DE82EF95
_POINT_INVERSE = pow(_POINT_BASE, -1, 1 << 64)
# Numbers computed at a time, so that the table of functions by runs stays in the processor's cache.
BLOCK = 1 << 15


@dataclass(frozen=True)
class OrderMinConfig:
    k: int = 8  # code points in a run
    take: int = 2  # runs in a tuple
    size: int = 32  # components of a fingerprint
    range_rows: int = 1024  # rows of a doc_id range
    most_ranges: int = 20_000  # ranges are planned on the driver; beyond it they get longer, streamed all the same


class OrderMinHash:
    def __init__(self, config: OrderMinConfig) -> None:
        self.config = config
        seeds = mix(np.arange(1, 2 * config.size + 1, dtype=np.uint64))
        self.flips = seeds[: config.size, None]
        self.factors = seeds[config.size:, None] | np.uint64(1)

    def numbered_runs(self, points: np.ndarray) -> np.ndarray:
        """A hash of every run with its occurrence number, in text order; a shorter text is one run."""
        n, k = len(points), min(self.config.k, len(points))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers_of(_POINT_BASE, n), out=sums[1:])
        runs = mix((sums[k:] - sums[: n + 1 - k]) * powers_of(_POINT_INVERSE, n + 1)[: n + 1 - k])
        # Sorting (hash, place) packed in one number finds equal runs, in text order.
        bits = np.uint64(max(20, len(runs).bit_length()))
        places = np.uint64((1 << int(bits)) - 1)
        packed = np.sort((runs & ~places) | np.arange(len(runs), dtype=np.uint64))
        heads = packed >> bits
        again = np.flatnonzero(heads[1:] == heads[:-1]) + 1
        if len(again):
            # Number within a stretch of equals: steps since the stretch began.
            begin = np.concatenate(([True], again[1:] != again[:-1] + 1))
            number = np.arange(len(again)) - np.maximum.accumulate(np.where(begin, np.arange(len(again)), 0)) + 1
            where = (packed[again] & places).astype(np.int64)
            runs[where] = mix(runs[where] + number.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        return runs

    def components(self, text: str) -> np.ndarray:
        """``size`` hashes of 32 bits; none for an empty text."""
        if not text:
            return np.zeros(0, np.uint32)
        runs = self.numbered_runs(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        n, size, take = len(runs), self.config.size, min(self.config.take, len(runs))
        least = np.empty((size, take), np.int64)
        step = max(1, BLOCK // n)
        for first in range(0, size, step):
            table = (runs ^ self.flips[first: first + step]) * self.factors[first: first + step]
            rows = np.arange(len(table))
            for i in range(take):
                at = table.argmin(axis=1)
                least[first: first + step, i] = at
                table[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(axis=1)
        out = np.full(size, np.uint64(take))
        for i in range(take):
            out = mix(out * np.uint64(0xA24BAED4963EE407) + runs[least[:, i]])
        return (out >> np.uint64(32)).astype(np.uint32)


def written(components: np.ndarray) -> str:
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components; texts that are both empty are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """The last third of the text replaced by as many first characters of the other (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def neighbour_batches(config: OrderMinConfig) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(config)
        out: list[tuple] = []
        held = None  # (group, doc_id, text, components) of the row before

        def compare(text: str, own: np.ndarray, other: str, others: np.ndarray) -> tuple:
            changed = edited(text, other)
            new = sketch.components(changed) if changed != text else own
            return (len(text), hashlib.sha256(changed.encode()).hexdigest(), written(own), written(new),
                    likeness(own, new), likeness(own, others))

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("group", "role", "doc_id", "text"))
            for group, role, doc_id, text in zip(*columns):
                text = text or ""
                if held is not None and held[0] != group:
                    held = None
                if role == 1 and held is None:
                    continue  # the range's end has been met already
                own = sketch.components(text)
                if held is not None:
                    out.append((held[1], *compare(held[2], held[3], text, own)))
                held = None if role == 1 else (group, doc_id, text, own)
                if role == 2:
                    out.append((doc_id, *compare(text, own, text, own)))
                    held = None
                if len(out) >= 512:
                    yield batch_of(out, batch.schema.field("doc_id").type)
                    out = []
        if out:
            yield batch_of(out, batch.schema.field("doc_id").type)
    return run


def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def fingerprint_documents(docs: DataFrame, config: OrderMinConfig = OrderMinConfig()) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next document's.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest. Rows that
    repeat a doc_id follow each other by text. A single row is its own next. A null or empty text has an
    empty fingerprint. A row with a null doc_id has no place in the order and is its own next. doc_id must be
    an integer; columns other than doc_id and text are not read.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("at")).where("at IS NOT NULL")
    rows = ids.count()
    ranges = max(1, min(rows // config.range_rows, config.most_ranges))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(ids.approxQuantile("at", shares, 0.1 / ranges))) if shares else []
    cuts = cuts or [0.0]  # ranges are named by a lookup that wants one cut at least
    splits = [-float("inf"), *cuts, float("inf")]
    placed = docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("at"))
    by_range = Bucketizer(splits=splits, inputCol="at", outputCol="group", handleInvalid="keep")
    placed = by_range.transform(placed).withColumn("group", F.col("group").cast("long"))
    heads = by_range.transform(docs.select("doc_id", F.col("doc_id").cast("double").alias("at")).where("at IS NOT NULL"))
    heads = heads.groupBy(F.col("group").cast("long").alias("group")).agg(F.max("doc_id").alias("doc_id")).collect()
    # At most most_ranges rows: the first document of each range also ends the range before it.
    heads = sorted(((r["group"], r["doc_id"]) for r in heads), reverse=True)
    ends = [(doc_id, heads[i - 1][0]) for i, (_, doc_id) in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = docs.sparkSession.createDataFrame(ends, f"doc_id {kind}, ended bigint")
    alone = F.col("doc_id").isNull()
    places = F.filter(
        F.array(
            F.struct(F.when(alone, -1 - F.pmod(F.xxhash64("text"), F.lit(997))).otherwise(F.col("group")).alias("group"),
                     F.when(alone, 2).otherwise(0).alias("role")),
            F.struct(F.col("ended").alias("group"), F.lit(1).alias("role"))),
        lambda x: x["group"].isNotNull())
    dealt = placed.join(F.broadcast(ends), "doc_id", "left").select("doc_id", "text", F.explode(places).alias("place"))
    dealt = dealt.select("place.group", "place.role", "doc_id", "text").repartition("group")
    dealt = dealt.sortWithinPartitions("group", "role", F.col("doc_id").desc(), "text")
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return dealt.mapInArrow(neighbour_batches(config), schema)

"""Near-duplicate documents by one-permutation MinHash.

Method. A document's set of word shingles is hashed once; the hash range is cut into bins and each
bin keeps its least hash. Empty bins are filled by optimal densification: bin j copies the first
filled bin in an order of bins that is random but the same for all documents, so that two documents
agree on a filled bin with the probability of their similarity. Runs of bins are hashed to bands.

Documents with equal sets are one class from the start, and only its smallest id goes on. Classes that
share a band form a bucket. A bucket does not emit all its pairs: its members are compared with a
centre (a star), and links are confirmed on the full sets. So a large bucket of copies costs one star.

A star misses links between members that are not similar to the centre. Buckets whose members still lie in
different components are therefore looked at once more: blocks of members outside the bucket's largest
component meet blocks of all its members in one task. It compares short fingerprints of the sets (all
shingles, or for texts of more than ``prints`` a sample of them drawn by hash) and gives up only the pairs across
components that are similar enough by these, within a margin that follows the size of the sample. Those are
confirmed as well, and no table of all pairs of a bucket is made. Of short texts no link of a bucket is lost. Two
long texts at the bound that are joined no other way are lost where the sample is off by more than six standard
deviations, which is less than 2e-7 at the default size, against 2e-6 for sharing no bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.graph import smallest_linked
from reviewlens.llm.words import (
    find_words, hash_spans, joined_hashes, lower_ascii, mix, slices, text_bytes,
)
from reviewlens.session import materialise


@dataclass(frozen=True)
class MinHashConfig:
    width: int = 5  # words in a shingle
    percent: int = 80  # link where 100 * intersection >= percent * union
    bands: int = 56  # at similarity 0.8, a pair shares no band with probability 2e-6
    rows: int = 7  # bins hashed to one band
    block_rows: int = 2048  # members of a bucket that a task holds twice
    prints: int = 512  # fingerprints of a set: about so many at most
    margin: float = 0.10  # what a share of the fingerprints may fall short of the similarity, at least
    deviations: float = 6.0  # the same, in standard deviations of a sample of its size
    broadcast_bytes: int = 8 << 20  # a list of ids up to this size is broadcast


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words none.
    """
    data, at = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, first = find_words(data, at)
    hashes = hash_spans(data, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == b:
            yield hashes[:0]
            continue
        own = np.sort(joined_hashes(hashes[a:b], min(width, b - a)))
        yield own[np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))]


@lru_cache(maxsize=4)
def borrow_order(bins: int) -> np.ndarray:
    """Row j: the bins that bin j looks at in turn, itself first."""
    random = np.random.Generator(np.random.PCG64(bins))
    order = np.argsort(random.random((bins, bins)), axis=1)
    own = np.arange(bins)[:, None]
    return np.concatenate((own, order[order != own].reshape(bins, bins - 1)), axis=1)


def signature(own: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of every bin of a non-empty sorted set, empty bins filled."""
    place = ((own >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    least = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    where = place[firsts].astype(np.int64)
    least[where] = own[firsts]
    filled[where] = True
    if len(where) < bins:
        order = borrow_order(bins)
        empty = np.flatnonzero(~filled)
        rows = order[empty]
        least[empty] = least[rows[np.arange(len(empty)), filled[rows].argmax(axis=1)]]
    return least


def sketch_batches(config: MinHashConfig) -> callable:
    bins = config.bands * config.rows
    factors = mix(np.arange(1, bins + 1, dtype=np.uint64)).reshape(config.bands, config.rows) | np.uint64(1)
    salts = mix(np.arange(1000, 1000 + config.bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, low, high, bands = [], [], [], []
                for own in shingle_sets(part.column("text"), config.width):
                    sizes.append(len(own))
                    low.append(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    high.append(mix(own ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                    if len(own):
                        least = signature(own, bins).reshape(config.bands, config.rows)
                        bands.append(mix((least * factors).sum(axis=1, dtype=np.uint64) ^ salts))
                    else:
                        bands.append(salts[:0])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
                keys = np.concatenate(bands) if bands else salts[:0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.array(np.array(low, np.uint64).view(np.int64)),
                     pa.array(np.array(high, np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))],
                    ["doc_id", "n_shingles", "low", "high", "bands"])
    return run


def confirm_batches(config: MinHashConfig) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_u"):
                keep = []
                sets = zip(shingle_sets(part.column("text_u"), config.width),
                           shingle_sets(part.column("text_v"), config.width))
                for left, right in sets:
                    both = np.sort(np.concatenate((left, right)))
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= config.percent * (len(both) - shared))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def print_batches(config: MinHashConfig) -> callable:
    """Fingerprints of 32 bits of each set, sorted: those with ``level`` leading zero bits, so that few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                levels, prints = [], []
                for own in shingle_sets(part.column("text"), config.width):
                    level = max(0, -(-len(own) // config.prints) - 1).bit_length()
                    own = np.unique((own >> np.uint64(32)).astype(np.uint32))
                    levels.append(level)
                    prints.append(own[own < (1 << (32 - level))].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(levels, pa.int32()), pa.array(prints, pa.binary())],
                    ["doc_id", "level", "prints"])
    return run


def compare_batches(config: MinHashConfig) -> callable:
    """Rows come sorted by (band, i, j): left rows of block i (side 0) meet all rows of block j (side 1)."""

    def likely(rows: pa.RecordBatch) -> pa.RecordBatch:
        side = rows.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids, roots, sizes, levels = (rows.column(n).to_numpy() for n in ("id", "root", "n_shingles", "level"))
        outer = rows.column("outer").to_numpy(zero_copy_only=False)
        prints = [np.frombuffer(x, np.uint32) for x in rows.column("prints").to_pylist()]
        # Prints of a row that are left at its own level and at the next one.
        counts = np.array([(len(x), np.searchsorted(x, 1 << (31 - level))) for x, level in zip(prints, levels.tolist())])
        owner = np.repeat(np.arange(len(right)), [len(prints[i]) for i in right])
        listed = np.concatenate([prints[i] for i in right]) if len(right) else np.zeros(0, np.uint32)
        order = np.argsort(listed, kind="stable")
        listed, owner = listed[order], owner[order]
        found = []
        for a in left.tolist():
            low, high = np.searchsorted(listed, prints[a], "left"), np.searchsorted(listed, prints[a], "right")
            spans = high - low
            at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            shared = np.bincount(owner[at], minlength=len(right))
            level = np.maximum(levels[a], levels[right])
            own = np.where(level > levels[a], counts[a, 1], counts[a, 0])
            others = np.where(level > levels[right], counts[right, 1], counts[right, 0])
            bound, union = config.percent / 100, own + others - shared
            spread = config.deviations * np.sqrt(bound * (1 - bound) / np.maximum(union, 1))
            least = bound - np.where(level > 0, np.maximum(config.margin, spread), 0.01)
            alike = shared >= least * union
            # More than one level apart is too different in size anyway.
            small, large = np.minimum(sizes[a], sizes[right]), np.maximum(sizes[a], sizes[right])
            # Two members outside the largest component meet twice and are taken once.
            keep = alike & (roots[right] != roots[a]) & (100 * small >= config.percent * large)
            keep &= ~outer[right] | (ids[right] > ids[a])
            b = right[keep]
            found.append((np.full(len(b), ids[a]), ids[b]))
        u = np.concatenate([x for x, _ in found]) if found else ids[:0]
        v = np.concatenate([x for _, x in found]) if found else ids[:0]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("band", "i", "j")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                if held and tuple(keys[a]) != key:
                    yield likely(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield likely(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def only(rows: DataFrame, ids: DataFrame, config: MinHashConfig) -> DataFrame:
    """Rows whose doc_id is in the materialised ids: by broadcast if these are few enough, else by a shuffle."""
    few = ids.count() * 8 <= config.broadcast_bytes
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough; only texts in pairs are moved."""
    ends = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v"))
    ids = materialise(ends.distinct())
    needed = materialise(only(docs.select("doc_id", "text"), ids, config))
    with_u = pairs.join(needed.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    with_both = with_u.join(needed.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_both.mapInArrow(confirm_batches(config), f"u {kind}, v {kind}")


def missed_pairs(crowded: DataFrame, components: DataFrame, docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs (u, v) in different components that share a bucket and may be similar enough."""
    labelled = materialise(crowded.where("size > 2").join(components.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", "n_shingles", "size", F.coalesce("root", "id").alias("root")))
    shares = labelled.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("major"))
    unsettled = materialise(labelled.join(shares.where("roots > 1"), "band").select(
        "band", "id", "n_shingles", "root", (F.col("root") != F.col("major")).alias("outer"),
        F.ceil(F.col("size") / config.block_rows).cast("int").alias("blocks")))
    ids = materialise(unsettled.select(F.col("id").alias("doc_id")).distinct())
    kind = crowded.schema["id"].dataType.simpleString()
    payload = only(docs.select("doc_id", "text"), ids, config).mapInArrow(
        print_batches(config), f"doc_id {kind}, level int, prints binary")
    rows = unsettled.join(materialise(payload).withColumnRenamed("doc_id", "id"), "id")
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    columns = ["id", "n_shingles", "root", "outer", "level", "prints"]
    left = rows.where("outer").select("band", own.alias("i"), other.alias("j"), F.lit(0).alias("side"), *columns)
    right = rows.select("band", other.alias("i"), own.alias("j"), F.lit(1).alias("side"), *columns)
    dealt = left.unionByName(right).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(compare_batches(config), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable by links, kept tells whether it is the row's own.
    A null, empty or wordless text has no shingles and links with nothing. Rows that repeat a doc_id
    are one node of the graph, linked by what links any of them. A row with a null doc_id takes no part:
    its component_id and kept are null. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, low bigint, high bigint, bands array<bigint>"
    sketches = materialise(docs.select("doc_id", "text").mapInArrow(sketch_batches(config), schema))
    named = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(
        named.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # Only sets that occur twice need a lookup of their class.
    copied = classes.where("copies > 1")
    key = ["low", "high", "n_shingles"]
    copies = named.select("doc_id", *key).join(copied.select(*key, "rep"), key).where("doc_id <> rep")
    copies = materialise(copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"), *key))
    links = copies.select("u", "v")
    single = named.join(copies.select(F.col("u").alias("doc_id"), *key), ["doc_id", *key], "left_anti")
    members = single.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"), "n_shingles")
    buckets = members.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    # Rows of buckets with several members; the rest of the corpus ends here.
    crowded = materialise(members.join(buckets, "band"))
    close = "100 * least({0}, {1}) >= {2} * greatest({0}, {1})".format
    sizes = crowded.where("id = first").groupBy(F.col("id").alias("u")).agg(F.max("n_shingles").alias("u_size"))
    pairs = crowded.where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"), "n_shingles")
    pairs = pairs.distinct().join(sizes, "u").where(close("u_size", "n_shingles", config.percent))
    pairs = materialise(pairs.select("u", "v").distinct())
    edges = materialise(confirm(pairs, docs, config))
    components = materialise(smallest_linked(links.union(edges)))
    more = materialise(missed_pairs(crowded, components, docs, config).distinct().join(pairs, ["u", "v"], "left_anti"))
    if not more.isEmpty():
        fresh = materialise(confirm(more, docs, config))
        known = components.select(F.col("node").alias("u"), F.col("root").alias("v"))
        components = materialise(smallest_linked(known.union(fresh)))
    moved = components.where("node <> root").select(F.col("node").alias("doc_id"), "root")
    return sketches.select("doc_id", "n_shingles").join(moved, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
        (F.coalesce("root", "doc_id") == F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """The rows of docs, all columns, but for documents that are linked to one with a smaller doc_id.

    One document of each component stays, and so do rows with a null doc_id. Rows with one doc_id are one document.
    """
    found = near_duplicates(docs, config)
    gone = materialise(found.where("NOT kept").select("doc_id").distinct())
    few = gone.count() * 8 <= config.broadcast_bytes
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest sequence are cut into pieces of that length and a rest. The pieces of a run of
documents with about ``shard_tokens`` tokens are a shard, and each shard is packed where its documents lie:

* pieces go in falling length, each into the open bin with the least room that still fits it;
* if none fits, a bin is opened at the size the plan has for the piece's length class, which may be larger than
  the piece needs, or at the size that costs least per token with what the pieces still to come can fill of it;
* the sizes are optimised jointly: whole packings are compared by cost, starting from one least size for all
  classes, and the size of one class at a time is changed until no such change makes the shard cheaper;
* every bin of a compared packing shrinks to the cheapest permitted size that holds its contents.

The cheapest packing of a shard is kept; it is a local optimum, never dearer than opening smallest sizes only. Costs are linear in the length with a quadratic part, as attention has.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.pieces import codec
from reviewlens.llm.words import find_words, slices, text_bytes


# Bins of a shard are fewer; numbers are compared faster than pairs.
BIN_BITS = 40
BIN_MASK = (1 << BIN_BITS) - 1


@dataclass(frozen=True)
class PackingConfig:
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    per_token: float = 1.0
    per_token_pair: float = 1 / 16_384  # a sequence of n tokens costs n * per_token + n * n * per_token_pair
    shard_tokens: int = 4_000_000

    def cost(self, size: int) -> float:
        return size * self.per_token + size * size * self.per_token_pair


def best_fit(lengths: np.ndarray, config: PackingConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, size of each bin, for pieces in falling length.

    Starts from the cheapest of the plans that open every bin at one size at least (or the least that holds the
    piece) and of those that judge each opened size, then changes the size of one length class at a time for as
    long as the packing gets cheaper.
    """
    sizes = sorted(config.sizes)
    pieces = lengths.tolist()
    limits = length_classes(sizes)
    classes = np.searchsorted(limits, lengths).tolist()
    present = sorted(set(classes))
    smallest = [sizes[bisect_left(sizes, limit)] for limit in limits]

    # The cheapest size that holds so much, and its cost, for every filling there can be.
    shrunk = [min((s for s in sizes if s >= n), key=config.cost) for n in range(sizes[-1] + 1)]
    costs = [config.cost(s) for s in shrunk]

    def priced(plan: list[int] | None, judged: list[int]) -> tuple[float, list[int] | None, tuple, set[int]]:
        bins, offsets, used, opened = fill(pieces, classes, plan, judged, config)
        return sum(map(costs.__getitem__, used)), plan, (bins, offsets, used), opened

    floors = [[max(floor, own) for own in smallest] for floor in sizes]
    tried = [priced(plan, sizes) for plan in floors]
    best = min(tried, key=lambda x: x[0])
    seen = set(map(tuple, floors))
    judged = min((priced(None, sizes[:n]) for n in range(1, len(sizes) + 1)), key=lambda x: x[0])
    better = True
    while better:
        better = False
        for own in present:
            for size in sizes:
                # A class that opens no bin has no say, so another size for it changes nothing.
                if size < smallest[own] or size == best[1][own] or own not in best[3]:
                    continue
                plan = [*best[1][:own], size, *best[1][own + 1:]]
                if tuple(plan) in seen:
                    continue  # was no cheaper than the best then, so it is not now
                seen.add(tuple(plan))
                other = priced(plan, sizes)
                if other[0] < best[0]:
                    best, better = other, True
    if judged[0] < best[0]:
        best = judged
    bins, offsets, used = best[2]
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array([shrunk[n] for n in used], np.int64)


def length_classes(sizes: list[int]) -> list[int]:
    """Upper bounds of the length classes: the sizes and their halves, thirds and quarters."""
    return sorted({size // part for size in sizes for part in (1, 2, 3, 4)} - {0})


def fill(lengths: list[int], classes: list[int], plan: list[int] | None, judged: list[int],
         config: PackingConfig) -> tuple[list[int], list[int], list[int], set[int]]:
    """Bin and offset of each piece, what each bin holds, and the classes of the pieces that opened one.

    A bin is opened at the size that plan has for the length class of its first piece. Without a plan the size
    of judged is taken that costs least per token once it is filled from the pieces still to come; if none holds
    the piece, the least size that does.
    """
    rooms: list[int] = []  # room left and bin as one number, sorted
    bins, offsets, used, opened = [], [], [], set()
    rising = [-n for n in lengths]
    for i, length in enumerate(lengths):
        at = bisect_left(rooms, length << BIN_BITS)
        if at < len(rooms):
            least = rooms.pop(at)
            room, own = least >> BIN_BITS, least & BIN_MASK
        else:
            if plan is not None:
                room = plan[classes[i]]
            else:
                room = min((s for s in judged if s >= length), default=None,
                           key=lambda s: config.cost(s) / (length + reach(rising, i + 1, s - length)))
                room = room or min(s for s in config.sizes if s >= length)
            own = len(used)
            used.append(0)
            opened.add(classes[i])
        bins.append(own)
        offsets.append(used[own])
        used[own] += length
        if room > length:
            insort(rooms, (room - length) << BIN_BITS | own)
    return bins, offsets, used, opened


def reach(rising: list[int], begin: int, room: int) -> int:
    """Tokens that go into room when the pieces from begin on (negative lengths, rising) are put in longest first."""
    filled = 0
    while room and (begin := bisect_left(rising, -room, begin)) < len(rising):
        length = -rising[begin]
        end = bisect_right(rising, -length, begin)
        taken = min(end - begin, room // length)
        filled += taken * length
        room -= taken * length
        begin = end
    return filled


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            counts = np.diff(find_words(*text_bytes(part.column("text")))[2])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int64))], ["doc_id", "n_tokens"])


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens with words (runs outside white space) as tokens; a null text has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count_batches, f"doc_id {kind}, n_tokens bigint")


def cut_points(counts: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of all documents end to end: the first token of every part, and each document's first part."""
    parts = -(-counts // largest)
    first = np.concatenate(([0], np.cumsum(parts)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    return np.repeat(np.cumsum(counts) - counts, parts) + within * largest, first


def word_part_batches(largest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column("text"))
                starts, _, first_word = find_words(data, at)
                counts = np.diff(first_word).astype(np.int64)
                cuts, first = cut_points(counts, largest)
                begins = starts[cuts].astype(np.int64)
                begins[first[:-1][counts > 0]] = at[:-1][counts > 0]  # with the space before the first word
                # A part ends where the next one of its text begins, or with the text.
                ends = np.append(begins[1:], 0)[:len(begins)]
                ends[first[1:][counts > 0] - 1] = at[1:][counts > 0]
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), lists], ["doc_id", "n_tokens", "parts"])
    return run


def word_parts(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """word_counts with parts: the text, cut before every word that begins a piece. Joined they are the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        word_part_batches(max(config.sizes)), f"doc_id {kind}, n_tokens bigint, parts array<string>")


def token_part_batches(model_path: str, largest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in slices(batch):
                ids = [own.packed_ids(text.as_py() or "") for text in part.column("text")]
                counts = np.array([len(x) for x in ids], np.int64)
                cuts, first = cut_points(counts, largest)
                listed = pa.array(np.concatenate(ids), pa.int32())
                inner = pa.ListArray.from_arrays(pa.array(np.append(cuts, counts.sum()), pa.int32()), listed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(first, pa.int32()), inner)],
                    ["doc_id", "n_tokens", "parts"])
    return run


def token_parts(docs: DataFrame, model_path: str, config: PackingConfig = PackingConfig()) -> DataFrame:
    """doc_id, n_tokens, parts: the token ids of op5's encoder, cut to pieces; a null or empty text has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        token_part_batches(model_path, max(config.sizes)), f"doc_id {kind}, n_tokens bigint, parts array<array<int>>")


class Shard:
    """Pieces that are packed together, gathered from the batches of a task."""

    def __init__(self, config: PackingConfig) -> None:
        self.config, self.held, self.tokens = config, [], 0

    def add(self, pieces: pa.RecordBatch, tokens: int) -> None:
        if pieces.num_rows:
            self.held.append(pieces)
            self.tokens += tokens

    def packed(self, first_bin: int) -> tuple[pa.RecordBatch, int]:
        """The pieces with their bins, which are numbered from first_bin on, and how many bins there are."""
        pieces = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        order = np.argsort(-pieces.column("n_tokens").to_numpy(), kind="stable")
        pieces = pieces.take(pa.array(order))
        bins, offsets, sizes = best_fit(pieces.column("n_tokens").to_numpy(), self.config)
        placed = [pa.array(bins + first_bin), pa.array(sizes[bins]), pa.array(offsets)]
        return piece_rows(pieces, placed), len(sizes)


def piece_rows(pieces: pa.RecordBatch, placed: list[pa.Array]) -> pa.RecordBatch:
    """Bins go between a piece's own columns and its content."""
    return pa.RecordBatch.from_arrays(
        [*pieces.columns[:4], *placed, *pieces.columns[4:]],
        [*pieces.schema.names[:4], "bin_id", "bin_size", "bin_offset", *pieces.schema.names[4:]])


def cut_pieces(batch: pa.RecordBatch, largest: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The pieces of documents with tokens, and a row for each document without any."""
    counts = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
    parts = -(-counts // largest)
    owner = np.repeat(np.arange(len(counts)), parts)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = piece * largest
    columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece), pa.array(start),
               pa.array(np.minimum(counts[owner] - start, largest))]
    names = ["doc_id", "piece", "start", "n_tokens"]
    none = np.flatnonzero(counts == 0)
    zeros = pa.array(np.zeros(len(none), np.int64))
    empty = [batch.column("doc_id").take(pa.array(none)), zeros, zeros, zeros]
    if "parts" in batch.schema.names:
        held = batch.filter(pa.array(counts > 0)).column("parts")
        columns.append(held.flatten())
        empty.append(pa.nulls(len(none), held.type.value_type))
        names.append("content")
    return pa.RecordBatch.from_arrays(columns, names), pa.RecordBatch.from_arrays(empty, names)


def pack_batches(config: PackingConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, next_bin = Shard(config), TaskContext.get().partitionId() << 40
        for batch in batches:
            pieces, empty = cut_pieces(batch, max(config.sizes))
            if empty.num_rows:
                yield piece_rows(empty, [pa.nulls(empty.num_rows, pa.int64())] * 3)
            upto, begin = np.cumsum(pieces.column("n_tokens").to_numpy()), 0
            while begin < pieces.num_rows:
                before = int(upto[begin - 1]) if begin else 0
                end = int(np.searchsorted(upto, before + config.shard_tokens - shard.tokens)) + 1
                end = min(end, pieces.num_rows)
                shard.add(pieces.slice(begin, end - begin), int(upto[end - 1]) - before)
                begin = end
                if shard.tokens >= config.shard_tokens:
                    rows, bins = shard.packed(next_bin)
                    yield rows
                    shard, next_bin = Shard(config), next_bin + bins
        if shard.held:
            yield shard.packed(next_bin)[0]
    return run


ROWS = "doc_id {}, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_size bigint, bin_offset bigint"


def pack_tokens(docs: DataFrame, model_path: str, config: PackingConfig = PackingConfig()) -> DataFrame:
    """What ``pack`` gives for ``token_parts``, with ids as content: encoded and packed in one pass of one worker."""
    encode, place = token_part_batches(model_path, max(config.sizes)), pack_batches(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return place(encode(batches))

    schema = ROWS.format(docs.schema["doc_id"].dataType.simpleString()) + ", content array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_words(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """What ``pack`` gives for ``word_parts``, with texts as content: cut and packed in one pass of one worker."""
    cut, place = word_part_batches(max(config.sizes)), pack_batches(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return place(cut(batches))

    schema = ROWS.format(docs.schema["doc_id"].dataType.simpleString()) + ", content string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(counts: DataFrame, config: PackingConfig = PackingConfig(), parts: str | None = None) -> DataFrame:
    """Pack documents (doc_id, n_tokens), token counts of any tokenizer, into bins of permitted sizes.

    Returns one row per piece: doc_id, piece (from 0), start (first token in the document), n_tokens, bin_id,
    bin_size, bin_offset (first token in the bin). A document without tokens (0 or null) has one row with
    bin_id, bin_size and bin_offset null. Rows that repeat a doc_id are packed each; a null doc_id is packed
    like any other; other columns are not read. ``parts`` names an array column with what each piece holds (its
    ids or text), one element for every max(sizes) tokens begun; pieces then carry it as ``content``.

    A shard is a run of rows of an input partition, so nothing moves and no key makes a large shard; the last
    shard of a partition is smaller. Bins depend on how the input is partitioned.
    """
    if not config.sizes or min(config.sizes) < 1:
        raise ValueError("permitted sizes are positive")
    kind = counts.schema["doc_id"].dataType.simpleString()
    tokens = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")
    held = [] if parts is None else [F.col(parts).alias("parts")]
    schema = ROWS.format(kind)
    if held:
        schema += f", content {counts.schema[parts].dataType.elementType.simpleString()}"
    return counts.select("doc_id", tokens, *held).mapInArrow(pack_batches(config), schema)

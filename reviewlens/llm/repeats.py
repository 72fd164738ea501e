"""Repeated passages across all documents by suffix trees over prefix groups.

A window of ``length`` words that starts anywhere else too is a repeat, and every word it covers goes.
In a suffix tree of all documents these are the leaves below internal nodes at least ``length`` words
deep. No machine holds that tree, so suffixes are split into groups by prefixes of two lengths:

1. Each window is filed under one fixed place in it, the anchor: the least-hashed run of ``prefix``
   words in the window, leftmost of equals. Equal windows have equal anchors at equal places, so they
   meet in the group of their anchor's prefix. Neighbouring windows mostly share an anchor and travel
   as one run of text, which moves far fewer bytes than one row per suffix.
2. A prefix that occurs once in the corpus holds no repeat: its runs end here (three quarters of all).
3. Groups of a size that fits in memory are read by tasks that sort the suffixes of their windows
   (prefix doubling over word ranks, cut at ``length``) and take the leaves under the deep nodes.
4. Prefixes with more runs than that (a line on every page) are split by the longest prefix, the whole
   window: a prefix of ``length`` words that two suffixes share is a deep node already, so it is enough to
   count windows, over the distinct runs of text only and with a merge before the shuffle.

Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.words import find_words, hash_spans, joined_hashes, slices, text_bytes
from reviewlens.session import materialise


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 35  # words in a window
    prefix: int = 18  # words in an anchor
    group_runs: int = 32_768  # runs of one prefix that one task may hold: some 10 MB of text
    tree_bytes: int = 2 << 20  # text of the groups that are sorted together; sorting takes some 25 times as much
    broadcast_keys: int = 1 << 21  # repeated prefixes up to this number are broadcast


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole text's words, to tell apart rows that repeat a doc_id."""
    return int(joined_hashes(hashes[:64], min(len(hashes), 64))[0] ^ hashes.sum(dtype=np.uint64)) if len(hashes) else 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span:]) if span < width else x


def find_runs(hashes: np.ndarray, first: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: the anchor's hash, first window, number of windows, text's index.

    ``hashes`` are the words of several texts, ``first`` where each text's words begin.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < config.length:
        return none.astype(np.uint64), none, none, none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = joined_hashes(hashes, config.prefix)
    places = np.arange(len(grams), dtype=np.uint64)
    # 32 bits of hash, then the place: the minimum is the leftmost of the least.
    ordered = (grams & np.uint64(0xFFFFFFFF00000000)) | places
    anchors = (sliding_min(ordered, config.length - config.prefix + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchors))
    whole = starts + config.length <= first[1:][owner[: len(anchors)]]
    starts, anchors = starts[whole], anchors[whole]
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    begin = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    sizes = np.diff(np.append(begin, len(starts)))
    return grams[anchors[begin]], starts[begin], sizes, owner[starts[begin]]


def prefix_batches(config: RepeatConfig) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column("text"))
                starts, ends, first = find_words(data, at)
                keys = find_runs(hash_spans(data, starts, ends), first, config)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["prefix"])
    return run


def run_batches(config: RepeatConfig, bodies: bool = True) -> callable:
    """Runs as rows, with their text or without; a column ``places`` (row, first) picks runs of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column("text"))
                starts, ends, first = find_words(data, at)
                hashes = hash_spans(data, starts, ends)
                keys, begin, sizes, owner = find_runs(hashes, first, config)
                if not len(keys):
                    continue
                rows = np.array([sequence_hash(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())],
                                np.uint64).view(np.int64)
                if "places" in part.schema.names:
                    picked = [{(x["row"], x["first"]) for x in p} for p in part.column("places").to_pylist()]
                    keep = np.array([(int(rows[o]), int(b - first[o])) in picked[o] for b, o in zip(begin, owner)], bool)
                    keys, begin, sizes, owner = keys[keep], begin[keep], sizes[keep], owner[keep]
                columns = [pa.array(keys.view(np.int64)), part.column("doc_id").take(pa.array(owner)),
                           pa.array(rows[owner]), pa.array((begin - first[owner]).astype(np.int32)),
                           pa.array(sizes.astype(np.int32))]
                names = ["prefix", "doc_id", "row", "first", "windows"]
                if not bodies:
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                # Runs overlap, so their text is several times the slice's: it is cut out run by run, without an index per byte.
                raw = data.tobytes()
                low, high = starts[begin].tolist(), ends[begin + sizes + config.length - 2].tolist()
                texts = pa.array([raw[a:b] for a, b in zip(low, high)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, texts], [*names, "body"])
    return run


def suffix_ranks(hashes: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` words (ends of the array wrap to nothing): prefix doubling."""
    ranks = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while span < length:
        step = min(span, length - span)  # the second half may overlap the first
        ahead = np.concatenate((ranks[step:], np.zeros(step, np.int64)))
        ranks = np.unique(ranks * np.int64(len(hashes) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        span += step
    return ranks


def deep_leaves(bodies: pa.Array, windows: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray]:
    """Which runs and which of their windows are leaves under an internal node of depth ``length`` or more."""
    known = bodies.dictionary_encode()
    which = known.indices.to_numpy(zero_copy_only=False)
    texts, copies = known.dictionary, np.bincount(which, minlength=len(known.dictionary))
    data, at = text_bytes(texts.cast(pa.binary()).view(pa.string()))
    starts, ends, first = find_words(data, at)
    ranks = suffix_ranks(hash_spans(data, starts, ends), config.length)
    per_text = np.diff(first) - config.length + 1  # windows of each distinct run
    text_of = np.repeat(np.arange(len(texts)), per_text)
    shift = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    leaf = ranks[first[:-1][text_of] + shift]
    below = np.bincount(leaf, weights=copies[text_of])  # leaves under the node that a rank names
    deep = below[leaf] > 1
    # Back from distinct runs to all runs.
    base = np.cumsum(per_text) - per_text
    run_of = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = deep[base[which[run_of]] + nth]
    return run_of[hit], nth[hit]


def stretches(run_of: np.ndarray, nth: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring repeated windows of a run as one row: doc_id, row, first, windows."""
    if len(run_of):
        new = np.concatenate(([True], (run_of[1:] != run_of[:-1]) | (nth[1:] != nth[:-1] + 1)))
        begin = np.flatnonzero(new)
    else:
        begin = np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(run_of)))
    rows = pa.array(run_of[begin])
    firsts = batch.column("first").to_numpy()[run_of[begin]] + nth[begin]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(firsts.astype(np.int32)),
         pa.array(sizes.astype(np.int32))], ["doc_id", "row", "first", "windows"])


def tree_batches(config: RepeatConfig) -> callable:
    """Rows come sorted by prefix; whole prefix groups are put together up to ``tree_bytes`` of text."""

    def leaves(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        windows = batch.column("windows").to_numpy().astype(np.int64)
        return stretches(*deep_leaves(batch.column("body"), windows, config), batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column("prefix").to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column("body")).to_numpy())
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and len(keys) and held[-1].column("prefix")[-1].as_py() != keys[0]:
                cuts = np.concatenate(([0], cuts))
            done = 0
            for cut in cuts.tolist():
                upto = size + (int(sizes[cut - 1]) if cut else 0) - (int(sizes[done - 1]) if done else 0)
                if upto >= config.tree_bytes:
                    held.append(batch.slice(done, cut - done))
                    yield leaves(held)
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += (int(sizes[-1]) if len(sizes) else 0) - (int(sizes[done - 1]) if done else 0)
        if sum(map(len, held)):
            yield leaves(held)
    return run


def window_batches(config: RepeatConfig) -> callable:
    """Every window of a run as a row of its own with the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                data, at = text_bytes(part.column("body").view(pa.string()))
                starts, ends, first = find_words(data, at)
                whole = joined_hashes(hash_spans(data, starts, ends), config.length)
                windows = np.diff(first) - config.length + 1
                owner = np.repeat(np.arange(len(windows)), windows)
                nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[first[owner] + nth].view(np.int64)), part.column("text_key").take(pa.array(owner)),
                     part.column("copies").take(pa.array(owner)), pa.array(nth.astype(np.int32))],
                    ["window", "text_key", "copies", "nth"])
    return run


def spread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with the list of their repeated windows, as stretches."""
    for batch in batches:
        lists = [np.sort(np.array(x, np.int64)) for x in batch.column("nths").to_pylist()]
        run_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        yield stretches(run_of, np.concatenate(lists) if lists else run_of, batch)


def crowded_windows(runs: DataFrame, config: RepeatConfig, found: str) -> DataFrame:
    """The repeated windows of runs whose prefix has too many runs for one task."""
    key = F.struct("prefix", F.xxhash64("body").alias("text"), F.length("body").alias("size"))
    runs = runs.withColumn("text_key", key)
    texts = materialise(runs.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("body").alias("body")))
    kind = "struct<prefix: bigint, text: bigint, size: int>"
    windows = materialise(texts.mapInArrow(
        window_batches(config), f"window bigint, text_key {kind}, copies bigint, nth int"))
    twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    deep = windows.join(twice, "window", "left_semi").groupBy("text_key").agg(F.collect_list("nth").alias("nths"))
    return runs.drop("body").join(deep, "text_key").select("doc_id", "row", "first", "nths").mapInArrow(spread_batches, found)


def repeated_windows(docs: DataFrame, config: RepeatConfig) -> DataFrame:
    """doc_id, row, first, windows: stretches of windows, by word, that start anywhere else too."""
    if not config.prefix <= config.length:
        raise ValueError("the prefix is longer than the window")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    prefixes = docs.select("text").mapInArrow(prefix_batches(config), "prefix bigint")
    shared = materialise(prefixes.groupBy("prefix").agg(F.count("*").alias("runs")).where("runs > 1"))
    plain = f"prefix bigint, doc_id {kind}, row bigint, first int, windows int"
    if shared.count() <= config.broadcast_keys:
        runs = texts.mapInArrow(run_batches(config), f"{plain}, body binary").join(F.broadcast(shared), "prefix")
    else:
        # Too many to broadcast: find the places first, and move only the texts and runs that have some.
        places = texts.mapInArrow(run_batches(config, bodies=False), plain).join(shared, "prefix").groupBy(
            F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("row", "first")).alias("places"))
        picked = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
        runs = picked.mapInArrow(run_batches(config), f"{plain}, body binary").join(shared, "prefix")
    found = f"doc_id {kind}, row bigint, first int, windows int"
    runs = materialise(runs)
    fitting = runs.where(F.col("runs") <= config.group_runs).drop("runs")
    leaves = fitting.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(tree_batches(config), found)
    crowded = runs.where(F.col("runs") > config.group_runs).drop("runs")
    return leaves.union(crowded_windows(crowded, config, found))


def keep_batches(config: RepeatConfig, digest: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column("text"))
                starts, ends, first = find_words(data, at)
                hashes = hash_spans(data, starts, ends)
                there = part.column("text").is_valid().to_pylist()
                removed, kept = [], []
                for i, found in enumerate(part.column("repeats").to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    gone = np.zeros(b - a + 1, np.int32)
                    row = int(np.uint64(sequence_hash(hashes[a:b])).astype(np.int64)) if found else 0
                    for x in found or ():
                        if x["row"] == row:
                            gone[x["first"]] += 1
                            gone[x["first"] + x["windows"] + config.length - 1] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    removed.append(b - a - int(stay.sum()))
                    text = data[at[i]: at[i + 1]].tobytes()
                    if removed[-1]:
                        words = text.split()
                        text = b" ".join([words[j] for j in np.flatnonzero(stay).tolist()])
                    elif digest:
                        text = b" ".join(text.split())
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode() if there[i] else None)
                names = [n for n in part.schema.names if n not in ("text", "repeats")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    [*names, "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), digest: bool = False,
                   others: bool = False) -> DataFrame:
    """Remove every word covered by a window that starts anywhere else too, in whichever document.

    Returns doc_id, n_words, n_removed and ``kept``: the words left, joined by one space (a text without
    repeats as it is, null for null), or with ``digest`` their SHA-256. With ``others`` a struct of that name
    holds the columns of docs but text, whatever their names. A null or empty text has no words; texts shorter
    than a window stay whole. Rows that repeat a doc_id are judged one by one, and equal rows repeat each other.
    """
    repeats = materialise(repeated_windows(docs, config)).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("row", "first", "windows")).alias("repeats"))
    rows = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")]
                                           if others else []))
    joined = rows.join(repeats, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "text"])
    schema = schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType())
    return joined.mapInArrow(keep_batches(config, digest), schema)

"""Byte-level BPE with word ends: a table of distinct words, joined back by position.

Method. A merge never crosses the border of a word, so a word's ids depend on the word alone:

1. texts are split into words, in blocks of some megabytes; a block is one row with its distinct words
   (most frequent first) and the number of each word in text order;
2. distinct words are dealt to buckets by hash; the table of distinct words is spread over the buckets, and
   the task that a bucket's rows stream through encodes each word once, by merges;
3. an id-to-piece join gives each block the pieces of the ids that it uses;
4. ids come back to their block by its number and their place in the bucket's list, and ids and pieces go to
   the positions of each document.

Words cross the network once per block and positions once, compressed; ids never do for every occurrence.
Blocks and buckets have a bounded size, but a text stays whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import input_bytes, join_by_size, materialise, measure

# Words of up to so many symbols are merged by scanning for the best pair, longer ones with a heap.
SCANNED = 64


@dataclass(frozen=True)
class BlockConfig:
    """A block ends with the text that reaches ``chars`` or ``words`` (distinct ones)."""

    chars: int = 16_000_000
    words: int = 400_000
    bytes_per_bucket: int = 16_000_000  # of input, as the planner knows it
    least_buckets: int = 64
    most_buckets: int = 8192
    words_kept: int = 1_000_000  # of a bucket's table; it starts anew when it is full

    def buckets(self, input_size: int) -> int:
        return max(self.least_buckets, min(self.most_buckets, -(-input_size // self.bytes_per_bucket)))


class WordBpe:
    """Splitter and merger of one tokenizer file (BPE, byte alphabet, a suffix that marks word ends).

    Files with other normalisers or splitters than NFC, white space, lower case and one pattern of words,
    or with added tokens that strip or need a word to themselves, are refused. Splitting knows the characters
    of this interpreter's Unicode version; texts with newer ones are split by the file's own rules.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.path = spec["model"], path
        self.suffix = model["end_of_word_suffix"] or ""
        self.id_of: dict[str, int] = model["vocab"]
        self.pieces = {i: piece for piece, i in self.id_of.items()}
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
        self.rank = {(left, right): n for n, (left, right) in enumerate(pairs)}
        for kind, want in (("type", "BPE"), ("dropout", None), ("unk_token", None), ("continuing_subword_prefix", None),
                           ("byte_fallback", False), ("ignore_merges", False)):
            if model.get(kind) not in (want, None, False):
                raise ValueError(f"models with {kind} {model[kind]!r} are not supported")
        normal = [step["type"] for step in spec["normalizer"]["normalizers"]]
        split, alphabet = spec["pre_tokenizer"]["pretokenizers"]
        if normal != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or (
                alphabet["type"] != "ByteLevel" or alphabet["add_prefix_space"] or alphabet["use_regex"]):
            raise ValueError("the file's normaliser or splitter is not supported")
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("files with a decoder or a post-processor are not supported")
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
        others = (b for b in range(256) if b not in plain)
        self.symbol = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.byte_of = {c: b for b, c in self.symbol.items()}
        if any(c + end not in self.id_of for c in self.byte_of for end in ("", self.suffix)):
            raise ValueError("the vocabulary lacks bytes")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        # The same for texts in lower-case ASCII, where the faster module has all it needs.
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.special: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"added token {token['content']!r} is not supported")
            self.special[token["content"]] = token["id"]
            self.pieces[token["id"]] = token["content"]
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self.common: set[str] = set()  # characters seen that this interpreter knows

    def split(self, text: str) -> list[str]:
        """Words in text order; an added token in the text is a word of its own, as it is written."""
        if self.special_split is None or not any(name in text for name in self.special):
            return self.split_plain(text)
        parts = self.special_split(text)
        return [word for n, part in enumerate(parts) for word in ([part] if n % 2 else self.split_plain(part))]

    def split_plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        chars = set(text) - self.common
        if any(unicodedata.category(c) == "Cn" for c in chars):
            return self.split_newer(text)
        if len(self.common) < 200_000:
            self.common |= chars
        # Lower case goes character by character, so a sigma at a word's end is like any other.
        return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def split_newer(self, text: str) -> list[str]:
        """Texts with characters that this interpreter's tables don't have yet, by the file's own rules."""
        rules = file_rules(self.path)
        marked = rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in word).decode() for word, _ in marked]

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        parts = [self.symbol[b] for b in word.encode()]
        if not parts:
            return []
        parts[-1] += self.suffix
        merged = self.merge_short(parts) if len(parts) <= SCANNED else self.merge_long(parts)
        return [self.id_of[part] for part in merged]

    def merge_short(self, parts: list[str]) -> list[str]:
        """Always the best-ranked pair, the leftmost of equals."""
        rank, never = self.rank.get, len(self.rank)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same for words of any length: pairs in a heap, symbols in a chain."""
        rank = self.rank.get
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, at) for at, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        gone, end = [False] * len(parts), len(parts)
        while heap:
            best, at = heapq.heappop(heap)
            right = after[at] if not gone[at] else end
            if right == end or rank((parts[at], parts[right])) != best:
                continue  # one of the two has been merged since
            parts[at] += parts[right]
            gone[right] = True
            after[at] = after[right]
            if after[at] != end:
                before[after[at]] = at
                if (r := rank((parts[at], parts[after[at]]))) is not None:
                    heapq.heappush(heap, (r, at))
            if before[at] >= 0 and (r := rank((parts[before[at]], parts[at]))) is not None:
                heapq.heappush(heap, (r, before[at]))
        return [part for part, dead in zip(parts, gone) if not dead]


@lru_cache(maxsize=4)
def codec(path: str) -> WordBpe:
    """One codec per file and Python worker."""
    return WordBpe(path)


@lru_cache(maxsize=4)
def file_rules(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all lowest bytes first: most are small, so the other bytes are mostly zero."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4").reshape(-1)


def block_row(block: int, keys: list, rows: list[np.ndarray], numbers: Numbers, key_type: pa.DataType, buckets: int) -> pa.RecordBatch:
    """One block: its documents with the number of words of each, all word numbers in text order, and its words.

    Words are numbered by falling frequency and listed by bucket in that order, separated by spaces, which no
    word holds, and compressed; ``bucket_of`` has the bucket of each number.
    """
    places = np.concatenate(rows)
    order = np.argsort(-np.bincount(places, minlength=len(numbers)), kind="stable")
    renamed = np.empty(len(order), np.uint32)
    renamed[order] = np.arange(len(order))
    words = np.array(list(numbers), object)[order]
    bucket_of = np.array([zlib.crc32(word.encode()) % buckets for word in words.tolist()], np.uint32)
    used = np.unique(bucket_of)
    listed = pa.StructArray.from_arrays(
        [pa.array(used.astype(np.int32)),
         pa.array([zstandard.compress(" ".join(words[bucket_of == b].tolist()).encode()) for b in used.tolist()], pa.binary())],
        ["bucket", "words"])
    docs = pa.StructArray.from_arrays(
        [pa.array(keys, key_type), pa.array([len(row) for row in rows], pa.int32())], ["doc_id", "n_words"])
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), listed),
         pa.array([squeeze(bucket_of)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), docs),
         pa.array([squeeze(renamed[places])], pa.binary())], ["block", "words", "bucket_of", "docs", "places"])


def split_blocks(path: str, config: BlockConfig, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = codec(path), TaskContext.get().partitionId() << 32, 0
        keys, rows, numbers, chars, key_type = [], [], Numbers(), 0, None
        for batch in batches:
            key_type = batch.column("doc_id").type
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                words = own.split(text)
                rows.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                keys.append(key.as_py())
                chars += len(text) + 1
                if chars >= config.chars or len(numbers) >= config.words:
                    yield block_row(part + number, keys, rows, numbers, key_type, buckets)
                    keys, rows, numbers, chars, number = [], [], Numbers(), 0, number + 1
        if keys:
            yield block_row(part + number, keys, rows, numbers, key_type, buckets)
    return run


def split_documents(docs: DataFrame, path: str, config: BlockConfig = BlockConfig()) -> DataFrame:
    """Blocks of documents with their distinct words; written, so that block numbers stay what they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    return materialise(docs.mapInArrow(
        split_blocks(path, config, config.buckets(input_bytes(docs))),
        "block bigint, words array<struct<bucket: int, words: binary>>, bucket_of binary, "
        f"docs array<struct<doc_id: {kind}, n_words: int>>, places binary"))


def encode_buckets(path: str, config: BlockConfig) -> Callable:
    """Ids of the listed words of each row, by a table in which each distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bucket = codec(path), None
        table: dict[str, list[int]] = {}
        for batch in batches:
            sizes, ids = [], []
            for this, words in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if this != bucket or len(table) > config.words_kept:
                    bucket, table = this, {}
                found = []
                for word in zstandard.decompress(words.as_py()).decode().split(" "):
                    if word not in table:
                        table[word] = own.encode_word(word)
                    found.append(table[word])
                sizes.append(squeeze(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(squeeze(np.fromiter(chain.from_iterable(found), np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())],
                ["block", "bucket", "sizes", "ids"])
    return run


def encode_listed(blocks: DataFrame, path: str, config: BlockConfig = BlockConfig()) -> DataFrame:
    """block, bucket, sizes, ids: how many ids each listed word has, and the ids, both compressed.

    All rows of a bucket pass through one task, one after the other.
    A word occurs once per block, so buckets of hashed words are of equal size however common a word is.
    """
    listed = blocks.select("block", F.inline("words"))
    return listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        encode_buckets(path, config), "block bigint, bucket int, sizes binary, ids binary")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of the tokenizer file; as bounded as the file."""
    return spark.createDataFrame(sorted(codec(path).pieces.items()), "id int, piece string")


def decode_rows(rows: DataFrame, key: str, pieces: DataFrame) -> DataFrame:
    """(key, text) of rows (key, ids): the pieces of the ids, in their order, joined by one space.

    ``key`` must tell rows apart. Unknown ids are passed over; null or empty ids give an empty text.
    """
    placed = rows.select(key, F.posexplode_outer("ids").alias("place", "id"))
    known = join_by_size(placed, pieces, ["id"], "left", measure(pieces)[1], [key, "place"])
    # The group is the ids of one row.
    found = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece"))))
    return known.groupBy(key).agg(found.alias("found")).select(key, F.array_join("found.piece", " ").alias("text"))


def used_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different ids of each block."""
    for batch in batches:
        for block, encoded in zip(batch.column("block"), batch.column("encoded").to_pylist()):
            ids = np.unique(np.concatenate([unsqueeze(entry["ids"]) for entry in encoded]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.as_py()] * len(ids), pa.int64()), pa.array(ids.astype(np.int32))], ["block", "id"])


def fill_places(keep_ids: bool) -> Callable:
    """Ids and pieces of a block's words, back at the positions of each of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in ("encoded", "pieces", "bucket_of", "places")}
                bucket_of, places = unsqueeze(row["bucket_of"]), unsqueeze(row["places"])
                ids, text, sizes = (np.empty(len(bucket_of), kind) for kind in (object, object, np.int64))
                piece_of = {p["id"]: p["piece"] for p in row["pieces"] or []}
                for entry in row["encoded"] or []:
                    mine, own_sizes = bucket_of == entry["bucket"], unsqueeze(entry["sizes"])
                    flat, ends = unsqueeze(entry["ids"]).tolist(), np.cumsum(own_sizes).tolist()
                    decimal, shown = list(map(str, flat)), list(map(piece_of.__getitem__, flat))
                    sizes[mine] = own_sizes
                    ids[mine] = [" ".join(decimal[a:b]) for a, b in zip([0, *ends], ends)]
                    text[mine] = [" ".join(shown[a:b]) for a, b in zip([0, *ends], ends)]
                docs = batch.column("docs")[n].values
                counts, id_digests, text_digests, all_ids, begin = [], [], [], [], 0
                for n_words in docs.field("n_words").to_pylist():
                    at = places[begin: begin + n_words]
                    begin += n_words
                    joined = " ".join(ids[at].tolist())
                    counts.append(int(sizes[at].sum()))
                    id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_digests.append(hashlib.sha256(" ".join(text[at].tolist()).encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(list(map(int, joined.split())))
                columns = [docs.field("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                           pa.array(text_digests, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode_documents(
    docs: DataFrame, path: str, keep_ids: bool = False, config: BlockConfig = BlockConfig()
) -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Ids are those of the file's tokenizer without special tokens added; those written in a text count. Digests
    are of decimal ids joined by one space, and of the decoded text. A null or empty text, or one of white
    space, has no ids. Rows with a null or repeated doc_id are encoded like all others; columns other than
    doc_id and text are not read. ``path`` must name a file that every executor has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = split_documents(docs, path, config)
    # Grouped are the words, and below the different ids, of one block.
    # The filter is what the join below asks for anyway; with it both uses of the rows read one exchange.
    encoded = encode_listed(blocks, path, config).where("block IS NOT NULL").groupBy("block").agg(
        F.collect_list(F.struct("bucket", "sizes", "ids")).alias("encoded"))
    used = encoded.mapInArrow(used_ids, "block bigint, id int")
    pieces = piece_table(docs.sparkSession, path)
    named = join_by_size(used, pieces, ["id"], "inner", measure(pieces)[1], ["block"])
    named = named.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return blocks.select("block", "bucket_of", "docs", "places").join(encoded, "block", "left").join(
        named, "block", "left").mapInArrow(fill_places(keep_ids), schema)

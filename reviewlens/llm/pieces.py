"""SentencePiece encoding and decoding by backtracking, for merge-type (BPE) models.

Method. A sequence of pieces is the encoding of a text exactly if each two neighbours stay as they
are when their joined text is merged anew; neighbours that would merge across their border can't
stand side by side. So the encoder walks left to right: an Aho-Corasick automaton gives all pieces
that start at a position, the longest compatible one is taken, and when none is left the position is
marked as failed and the walk goes back to the next shorter piece before it. No position fails
twice, so the walk is linear but for the checks, and those are kept in a table.

No piece holds a space mark after another character, and characters that no piece holds side by side
never merge. A text therefore falls into units (spaces with the run of such a class of characters
after them) that are encoded one by one; frequent units are kept in a bounded table per worker.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
# Bounds of the per-worker tables: what they keep decides how fast a text is encoded, never the result.
UNITS_KEPT = 400_000
UNIT_BYTES_KEPT = 64 << 20
LONGEST_KEPT = 256
PAIRS_KEPT = 500_000


class Units(dict):
    """What ``make`` gives for a unit, kept for the units asked for last.

    There are two generations: a full one becomes the old one, and what is asked for again moves on to the
    new one. So units in use stay, and at most twice the bounds are held. Long units are not kept.
    """

    def __init__(self, make: Callable[[str], str | bytes], kept: int | None = None) -> None:
        super().__init__()
        self.make, self.old, self.size = make, {}, 0
        self.kept = UNITS_KEPT if kept is None else kept

    def __missing__(self, unit: str) -> str | bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.make(unit)
        length = len(unit)
        if length <= LONGEST_KEPT:
            if len(self) >= self.kept or self.size >= UNIT_BYTES_KEPT:
                self.old, self.size = dict(self), 0
                self.clear()
            self[unit] = found
            self.size += 4 * length + len(found)
        return found


@dataclass(frozen=True)
class Growth:
    """How a piece comes about from its characters: the symbols at both ends, each with the rank of the merge that
    takes it up (infinite for the last), whether ranks only rise, and whether the piece is reached at all."""

    left: list[tuple[str, float]]
    right: list[tuple[str, float]]
    rising: bool
    whole: bool


class PieceCodec:
    """Encoder and decoder of one model file whose pieces were merged pairwise (BPE).

    The file is read through the public library; nothing else of the library is used. Models with pieces
    that cross a word's start, or without byte pieces, are refused; a normaliser other than identity is not
    looked for and must not be there.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.size = size
        self.start, self.unknown = size + 1, size  # stand for the text's start and a foreign character
        self.spoken: list[str | None] = [None] * size  # a piece with marks as spaces
        self.length = [1] * (size + 2)
        self.byte_of: dict[int, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.piece_of: dict[int, str] = {}
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[1:-1], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.spoken[i] = piece.replace(MARK, " ")
                self.length[i] = len(piece)
                self.piece_of[i], self.id_of[piece] = piece, i
                self.rank[piece] = -model.get_score(i)
        if any(MARK in piece.lstrip(MARK) for piece in self.id_of):
            raise ValueError("a piece crosses the start of a word")
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        # The longest piece that is a proper prefix of a piece: what to try when the piece doesn't fit.
        self.shorter = [-1] * (size + 2)
        for piece, i in self.id_of.items():
            prefixes = (self.id_of.get(piece[:n]) for n in range(len(piece) - 1, 0, -1))
            self.shorter[i] = next((x for x in prefixes if x is not None), -1)
        self.units = re.compile(self.unit_pattern()).findall
        self.pairs: dict[int, dict[int, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.grown: dict[int, Growth] = {}
        self.known = Units(lambda unit: ",".join(map(str, self.encode_unit(unit.replace(" ", MARK)))))
        # Packing keeps this table alone, encoding the two others together.
        self.packed = Units(lambda unit: array("i", self.encode_unit(unit.replace(" ", MARK))).tobytes(), UNITS_KEPT * 7 // 4)
        self.back = Units(lambda unit: self.decode_pieces(list(map(int, self.known[unit].split(",")))))

    def unit_pattern(self) -> str:
        """Spaces with a run of one class of characters; classes join what some piece holds side by side."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for left, right in {pair for piece in self.id_of for pair in zip(piece, piece[1:])}:
            root[find(right if left == MARK else left)] = find(right)
        classes: dict[str, list[str]] = {}
        for c in sorted(root):
            classes.setdefault(find(c), []).append(re.escape(c))
        runs = "|".join(f"[{''.join(x)}]+" for x in sorted(classes.values(), key=len, reverse=True))
        return f"(?s: *(?:{runs})| +|.)"

    def merges(self, parts: list[str]) -> Iterator[tuple[int, float]]:
        """Merge characters in place: always the best-scored pair, the leftmost of equals; its place and rank."""
        rank, never = self.rank.get, float("inf")
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            yield at, best
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], never)

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        for _ in self.merges(parts):
            pass
        return parts

    def growth(self, piece: int) -> Growth:
        """Found once for each piece: there are no more than pieces in the model."""
        known = self.grown.get(piece)
        if known is None:
            parts, left, right, before, rising = list(self.piece_of[piece]), [], [], -float("inf"), True
            for at, rank in self.merges(parts):
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                rising, before = rising and rank >= before, rank
            last = float("inf")
            known = self.grown[piece] = Growth(
                [*left, (parts[0], last)], [*right, (parts[-1], last)], rising, len(parts) == 1)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, side by side, stay as they are when their text is merged anew."""
        if self.unknown in (left, right):
            return True
        if self.n_pairs >= PAIRS_KEPT:
            for known in self.pairs.values():
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        fits = self.pairs[left][right] = self.stays(left, right)
        return fits

    def stays(self, left: int, right: int) -> bool:
        """Merging anew goes on in both pieces as in each alone until something merges across the border.

        Where ranks only rise in both, a rank is a point in time, and of two symbols that meet at the border the
        one whose own merge comes first gives way (the left one of equals). They merge with each other if that
        comes before both: before the left one's, which is further left, and no later than the right one's.
        """
        other = self.growth(right)
        if left == self.start or not other.whole:
            return other.whole
        own = self.growth(left)
        if not (own.rising and other.rising):
            return self.merged(self.piece_of[left] + self.piece_of[right]) == [self.piece_of[left], self.piece_of[right]]
        i = j = 0
        while True:
            (x, until), (y, other_until) = own.right[i], other.left[j]
            across = self.rank.get(x + y)
            if across is not None and across < until and across <= other_until:
                return False
            if until == other_until == float("inf"):
                return True
            if until <= other_until:
                i += 1
            else:
                j += 1

    def encode_unit(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks."""
        n = len(text)
        longest = [self.unknown] * n
        shorter, lengths, pairs, compatible = self.shorter, self.length, self.pairs, self.compatible
        for last, i in self.automaton.iter(text):
            longest[last + 1 - lengths[i]] = i  # ends rise, so the longest piece stays
        longest.append(-1)
        ids: list[int] = []
        at, before = 0, self.start
        now = longest[0]
        while at < n:
            fitting = pairs[before].get
            while now >= 0:
                fits = fitting(now)
                if compatible(before, now) if fits is None else fits:
                    break
                now = shorter[now]
            if now >= 0:
                ids.append(now)
                at, before = at + lengths[now], now
                now = longest[at]
            else:
                longest[at] = -1  # failed: nothing is tried here again
                last = ids.pop()
                at -= lengths[last]
                before = ids[-1] if ids else self.start
                now = shorter[last]
        if self.unknown not in ids:
            return ids
        known: list[int] = []
        at = 0
        for i in ids:
            known += [self.byte_ids[b] for b in text[at].encode()] if i == self.unknown else [i]
            at += lengths[i]
        return known

    def split(self, text: str) -> list[str]:
        """The units of a text, after the one space that is put before every text that isn't empty."""
        return self.units(" " + text.replace(MARK, " ")) if text else []

    def encode_and_decode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text that these ids decode to."""
        units = self.split(text)
        return ",".join(map(self.known.__getitem__, units)), "".join(map(self.back.__getitem__, units))[1:]

    def packed_ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed_ids(text).tolist()

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids with marks as spaces; runs of byte pieces are read as UTF-8."""
        parts = [self.spoken[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out: list[str] = []
        run = bytearray()
        for i, part in zip(ids, parts):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            out.append(part or "")
        return "".join(out) + run.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """decode(encode(text)) gives the text back, marks as spaces; one leading space is taken off."""
        text = self.decode_pieces(ids)
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def codec(model_path: str) -> PieceCodec:
    """One codec per model and Python worker."""
    return PieceCodec(model_path)


def encode_batches(model_path: str, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for text in batch.column("text"):
                ids, back = own.encode_and_decode(text.as_py() or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                id_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(list(map(int, ids.split(","))) if ids else [])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                       pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    One narrow pass, no shuffle; a task holds one Arrow batch of texts and two bounded tables. A null
    or empty text has no ids. Rows with a null or repeated doc_id are encoded like all others; columns
    other than doc_id and text are not read. ``model_path`` must name a file that every executor has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(encode_batches(model_path, keep_ids), schema)

"""Fill-in-the-middle: texts cut at two ranks and put together with the middle last.

Method. Over the units of a text (code points, or the matches of a pattern) stands an indexable skip
list: lane 0 links every unit to the next, a higher lane only some, and each link carries how many units
and how many code points it skips. A rank is reached by going along the highest lane for as long as the
link's units fit in what is left, then one lane down, and so on; the code points added up on the way are
the place to cut. Which units stand in which lane follows from a hash of their number alone, so lanes
are shared by all texts of a worker and a text only adds up its own widths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.words import mix

MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class FimConfig:
    plain_from: int = 90  # of 100: hashes from here on leave the text as it is
    spm_below: int = 20  # of 100: hashes below it put the suffix first
    unit: str | None = None  # a pattern whose matches are the units; None: code points
    key_prefix: str = "1:"  # the hash is that of this and the decimal key


class Lanes:
    """Numbers of the units that stand in each lane: every unit in lane 0, an eighth of a lane in the next."""

    def __init__(self) -> None:
        self.size = 0
        self.members: list[np.ndarray] = []
        self.below: list[np.ndarray] = []

    def grow(self, size: int) -> None:
        self.size = max(2 * self.size, size, 4096)
        numbers = np.arange(1, self.size, dtype=np.uint64)
        bits = mix(numbers * np.uint64(0x9E3779B97F4A7C15))
        self.members, self.below = [], [np.zeros(0, np.int64)]
        lane = np.arange(self.size)
        while len(lane) > 1:
            self.members.append(lane)
            raised = np.flatnonzero((bits[lane[1:] - 1] >> np.uint64(3 * (len(self.members) - 1))) & np.uint64(7) == 0) + 1
            raised = np.append(0, raised)  # every lane begins at the head
            self.below.append(raised)
            lane = lane[raised]
        self.members = self.members or [lane]

    def upto(self, size: int) -> list[np.ndarray]:
        """Members of each lane among the first units; higher lanes that hold the head only are left out."""
        if size > self.size:
            self.grow(size)
        found = []
        for lane in self.members:
            mine = lane[:np.searchsorted(lane, size)]
            if found and len(mine) < 2:
                break
            found.append(mine)
        return found


_LANES = Lanes()


class SkipList:
    """An indexable skip list over units with given widths in code points."""

    def __init__(self, widths: np.ndarray, lanes: Lanes = _LANES) -> None:
        self.units = len(widths)
        self.links: list[tuple[list[int] | np.ndarray, np.ndarray]] = []  # (units, code points) of each link
        members = lanes.upto(max(self.units, 1))
        self.below = lanes.below
        for lane in members:
            ends = np.append(lane[1:], self.units)
            self.links.append((ends - lane, np.add.reduceat(widths, lane) if self.units else widths))

    def place(self, rank: int) -> int:
        """Code points before the unit of a rank; the rank of the end is the number of units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        chars, at, left = 0, 0, rank
        for level in range(len(self.links) - 1, -1, -1):
            units, points = self.links[level]
            while left and at < len(units) and units[at] <= left:
                left -= int(units[at])
                chars += int(points[at])
                at += 1
            if not left:
                return chars
            if level:
                at = int(self.below[level][at])
        return chars


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit. What lies between matches belongs to the match before, at the start to the first."""
    if unit is None:
        return np.ones(len(text), np.int64)
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    if not starts:
        return np.array([len(text)] if text else [], np.int64)
    return np.diff([0, *starts[1:], len(text)])


def cut_text(key: object, text: str, config: FimConfig, unit: re.Pattern | None) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in that form."""
    widths = unit_widths(text, unit)
    n = len(widths)
    digest = hashlib.sha256(f"{config.key_prefix}{'' if key is None else key}".encode()).hexdigest()
    first, second, leave, suffix_first = (int(digest[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in MARKS) or leave % 100 >= config.plain_from:
        return n, "plain", None, None, text
    index = SkipList(widths)
    begin, end = (index.place(rank) for rank in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if suffix_first % 100 < config.spm_below:
        return n, "spm", begin, end - begin, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", begin, end - begin, f"<P>{prefix}<S>{suffix}<M>{middle}"


def cut_batches(config: FimConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(config.unit) if config.unit else None
        for batch in batches:
            rows = [cut_text(key.as_py(), text.as_py() or "", config, unit)
                    for key, text in zip(batch.column("doc_id"), batch.column("text"))]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.large_string()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every text.

    A narrow pass. Both cut ranks, and whether and how a text is rearranged, come from the key alone, so
    rows that repeat a key and text give the same result. A null text is empty, a null key hashes like an
    empty one. A text that is empty or holds a mark stays plain. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut_batches(config),
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut never makes a mark, so the first of each kind is the mark."""
    def after(text: Column, n: Column) -> Column:
        return F.substring(text, n + F.lit(len(MARKS[0]) + 1), F.length(text))

    rest = after(output, F.lit(0))
    first = F.when(form == "psm", F.substring_index(rest, "<S>", 1)).otherwise(F.substring_index(rest, "<P>", 1))
    rest = after(rest, F.length(first))
    second = F.substring_index(rest, "<M>", 1)
    third = after(rest, F.length(second))
    whole = F.when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))
    return F.when(form == "plain", output).otherwise(whole)

"""Texts as padded sequences of word ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.text import clean
from reviewlens.functions.tokens import cleaned_words
from reviewlens.operators.rows import ROW, spread_rows
from reviewlens.operators.vocabulary import WordIndex
from reviewlens.session import fits_broadcast, join_by_size


# Rows of a batch that are looked up together.
BATCH_ROWS = 512


def known_batches(shared: Any) -> Callable:
    """Batches with lists of words, or words joined by spaces, get the ids of the known ones, and those words, in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, numbers = shared.value
        listed, numbers = pa.array(listed, pa.string()), pa.array(numbers, pa.int32())
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            lists = batch.column("_words")
            if pa.types.is_string(lists.type):
                lists = pc.split_pattern(lists, " ")  # empty words are in no index
            words = lists.flatten()
            place = pc.index_in(words, value_set=listed)
            known = place.is_valid()
            upto = np.concatenate(([0], np.cumsum(known.to_numpy(zero_copy_only=False))))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(upto[np.concatenate(([0], np.cumsum(sizes)))], pa.int32())
            others = [n for n in batch.schema.names if n != "_words"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in others), pa.ListArray.from_arrays(offsets, numbers.take(place.drop_null())),
                 pa.ListArray.from_arrays(offsets, words.filter(known))], [*others, "ids", "words"])
    return run


def text_sequences(
    docs: DataFrame, key: str, text: str, index: WordIndex, carry: list[str] = [],
    words_of: Callable[[Column], Column] = cleaned_words,
) -> DataFrame:
    """(key, carry, ids, words): known words in text order; a text without any has empty arrays.

    Each row has its own, also where rows share a key or have none. ``words_of`` cuts the texts and should be
    what the index was fitted with. An index that can be broadcast goes to the tasks as a whole, and the words of a
    text are looked up together: no word becomes a row. A larger one is met by a join.
    """
    texts = spread_rows(docs, [key], text, carry)
    if fits_broadcast(index.size_bytes):
        rows = [tuple(r) for r in index.table.select("word", "idx").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(([w for w, _ in rows], [i for _, i in rows]))
        # Cleaned words are the text between spaces, which is cut faster in Arrow than into an array.
        words = clean(F.col(text)) if words_of is cleaned_words else words_of(F.col(text))
        lists = texts.select(key, *carry, words.alias("_words"))
        schema = T.StructType([f for f in lists.schema.fields if f.name != "_words"])
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("words", T.ArrayType(T.StringType()))
        return lists.mapInArrow(known_batches(shared), schema)
    words = texts.select(
        key, *carry, *ROW, F.posexplode_outer(words_of(F.col(text))).alias("pos", "word"))
    known = join_by_size(words, index.table.select("word", "idx"), ["word"], "left", index.size_bytes, [*ROW, "pos"])
    # The group is the words of one text.
    return (
        known.groupBy(key, *carry, *ROW)
        .agg(F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("pos", "idx", "word")))).alias("_s"))
        .select(key, *carry, F.col("_s.idx").alias("ids"), F.col("_s.word").alias("words"))
    )


def pad_front(ids: Column, length: int) -> Column:
    """Keep the last ``length`` ids and fill up with zeros in front."""
    n = F.size(ids)
    return F.concat(
        F.array_repeat(F.lit(0), F.greatest(F.lit(length) - n, F.lit(0))),
        F.slice(ids, F.greatest(n - F.lit(length), F.lit(0)) + F.lit(1), F.lit(length)),
    )


def pad_back(ids: Column, length: int) -> Column:
    """Keep the first ``length`` ids and fill up with zeros behind."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(kept), F.lit(0))))

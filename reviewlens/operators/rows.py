"""Telling rows apart whatever their keys are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import spread

# Columns that together name one row of a table; see ``spread_rows``.
ROW = ["_spot", "_row"]


def numbered_rows(docs: DataFrame, keys: list[str], text: str, carry: list[str] = []) -> DataFrame:
    """(keys, carry, ROW, text) of every row where it lies."""
    return docs.select(
        *keys, *carry, text,
        F.xxhash64(*keys, text, F.spark_partition_id()).alias("_spot"),
        F.monotonically_increasing_id().alias("_row"))


def spread_rows(docs: DataFrame, keys: list[str], text: str, carry: list[str] = [], part_bytes: int | None = None) -> DataFrame:
    """(keys, carry, ROW, text) of every row, spread evenly: rows that repeat a key, or have none, stay apart.

    ``_spot``, which deals the rows, is a hash of key, text and input partition, so neither a null or
    repeated key nor many copies of a text make a hot task. ``_row`` numbers the rows of an input partition.
    An input partition that has to be computed again may number its rows anew; it still sends every row
    to the same spot, so no row is lost or counted twice.
    """
    return spread(numbered_rows(docs, keys, text, carry), ["_spot"], part_bytes)

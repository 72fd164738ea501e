"""Exact stratified splits whose text never moves.

Every document gets a rank inside its class by a seeded hash of its key. Instead of ranking
all of them in one window per class, the job finds the hash at each cut: hash bins are
counted, the bin holding the cut is ranked alone, and the split is then a plain comparison
with the cut, evaluated where the rows already lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import byte_size, join_by_size, materialise

# Hex digits of the hash that name a bin: 65 536 bins per class.
BIN_DIGITS = 4

Part = tuple[str, Callable[[Column], Column]]


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def find_cuts(docs: DataFrame, key: str, label: str, seed: int, parts: list[Part]) -> DataFrame:
    """One row per class: the hash and key at the upper rank of every part."""
    keyed = docs.select(key, label).withColumn("_h", hash_order(key, seed))
    binned = keyed.withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    counts = materialise(binned.groupBy(label, "_bin").agg(F.count("*").alias("_n")))

    in_class = Window.partitionBy(label)
    running = in_class.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(in_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_part", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), upper(F.col("_total")).cast("long").alias("k"))
            for i, (_, upper) in enumerate(parts)
        ])))
        .select(label, "_bin", "_n", "_upto", F.col("_part.i").alias("_i"), F.col("_part.k").alias("_k"))
    )
    # The bin in which rank k falls, and its rank inside that bin: one row per class and part.
    cut_bins = materialise(
        ranked.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select(label, "_bin", "_i", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_m"))
    )
    in_bin = Window.partitionBy(label, "_i").orderBy("_h", key)
    candidates = join_by_size(binned, cut_bins, [label, "_bin"], "inner", byte_size(cut_bins), [key])
    at_cut = candidates.withColumn("_r", F.row_number().over(in_bin)).filter(F.col("_r") == F.col("_m"))
    return materialise(
        at_cut.groupBy(label).agg(*[
            F.max(F.when(F.col("_i") == i, F.struct("_h", key))).alias(f"_cut{i}") for i in range(len(parts))
        ]).select(label, *[
            c for i in range(len(parts))
            for c in (F.col(f"_cut{i}._h").alias(f"_h{i}"), F.col(f"_cut{i}.{key}").alias(f"_k{i}"))
        ])
    )


def split_at_cuts(docs: DataFrame, cuts: DataFrame, key: str, label: str, seed: int, parts: list[Part], rest: str) -> DataFrame:
    tagged = join_by_size(
        docs.withColumn("_h", hash_order(key, seed)), cuts, [label], "left", byte_size(cuts), [key]
    )
    split = F.lit(rest)
    for i, (name, _) in reversed(list(enumerate(parts))):
        here = (F.col("_h") < F.col(f"_h{i}")) | ((F.col("_h") == F.col(f"_h{i}")) & (F.col(key) <= F.col(f"_k{i}")))
        split = F.when(here, F.lit(name)).otherwise(split)
    return tagged.withColumn("split", split).select(*docs.columns, "split")


def split_by_rank(docs: DataFrame, key: str, label: str, seed: int, parts: list[Part], rest: str) -> DataFrame:
    """Add ``split``: the first part whose upper rank, a function of the class size, holds the row.

    ``key`` must be unique. Classes keep their proportions in every part.
    """
    cuts = find_cuts(docs, key, label, seed, parts)
    return split_at_cuts(docs, cuts, key, label, seed, parts, rest)


def validation_part(val_ratio: float) -> list[Part]:
    return [("val", lambda n: F.round(n.cast("double") * F.lit(val_ratio)))]


def train_val_split(docs: DataFrame, key: str, label: str, val_ratio: float, seed: int) -> DataFrame:
    """Carve a validation part of exactly round(n * ratio) rows out of each class."""
    return split_by_rank(docs, key, label, seed, validation_part(val_ratio), rest="train")


def three_way_split(
    docs: DataFrame, key: str, label: str, holdout_ratio: float, holdout_val_share: float, seed: int
) -> DataFrame:
    """Hold out a share of each class, then cut the held-out rows into validation and test."""
    train = 1.0 - holdout_ratio
    train_and_val = train + holdout_ratio * holdout_val_share
    return split_by_rank(
        docs, key, label, seed,
        [
            ("train", lambda n: F.floor(F.round(n.cast("double") * F.lit(train), 6))),
            ("val", lambda n: F.floor(F.round(n.cast("double") * F.lit(train_and_val), 6))),
        ],
        rest="test",
    )


def predefined_split(docs: DataFrame, is_test: Column, key: str, label: str, val_ratio: float, seed: int) -> DataFrame:
    """Keep a test part given by the data untouched and carve validation out of the rest."""
    parts = validation_part(val_ratio)
    cuts = find_cuts(docs.filter(~is_test), key, label, seed, parts)
    tagged = split_at_cuts(docs, cuts, key, label, seed, parts, rest="train")
    return tagged.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.col("split")))


def split_summary(docs: DataFrame, label: str) -> DataFrame:
    return docs.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("long")).alias("pos"),
        (F.count("*") - F.sum(F.col(label).cast("long"))).alias("neg"),
    )


def class_counts(docs: DataFrame, label: Column) -> DataFrame:
    return docs.groupBy(label.alias("class")).agg(F.count("*").alias("n"))


def pairing_check(docs: DataFrame, text: str, label: str) -> DataFrame:
    """One row: every text has a label and every label is 0 or 1."""
    return docs.agg(
        F.count(text).alias("n_texts"),
        F.count(label).alias("n_labels"),
        F.count_if(F.col(text).isNull() | F.col(label).isNull()).alias("n_unpaired"),
        F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("n_bad_labels"),
    ).withColumn("paired", (F.col("n_unpaired") == 0) & (F.col("n_bad_labels") == 0))

"""Connected components of an edge table by rounds of joins, for graphs of any size.

Large-star and small-star rounds: every node links its larger neighbours to its smallest neighbour,
then its smaller ones. Each round is two group-bys that merge before their shuffle and joins that
adaptive execution can split at a hot node; no node's neighbours are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import materialise


def smallest_linked(edges: DataFrame) -> DataFrame:
    """For edges (u, v): node, root with root the smallest node reachable; nodes without an edge are left out.

    Loops, repeated edges, either direction and null ends are fine: loops and nulls are dropped.
    The rounds stop when a round changes nothing, which is told by count and sum of row hashes.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = materialise(ordered.distinct())
    mark = fingerprint(state)
    while True:
        state = materialise(small_star(large_star(state)))
        now = fingerprint(state)
        if now == mark:
            break
        mark = now
    roots = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"] or 0


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()

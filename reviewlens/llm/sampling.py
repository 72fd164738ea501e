"""Bounded samples: the rows whose keys have the smallest hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import materialise

# How many times the rows asked for pass the first filter, so that each group rarely falls short.
SPARE = 4


def smallest_hashes(table: DataFrame, key: str, k: int, by: str | None = None) -> DataFrame:
    """The k different keys of each group with the smallest hashes (all, if fewer), written; one row each.

    Ranking all keys would send k rows of every task and group to one task. So a hash bound first leaves about
    SPARE * k keys of a group, by an estimate of how many different keys it has; if some group then has
    fewer than k, the bound is raised. A key that is repeated, however often, counts once.
    """
    group = [by] if by else []
    hashed = table.select(*group, key).withColumn("_h", F.xxhash64(key))
    sizes = materialise(hashed.groupBy(*group).agg(F.approx_count_distinct(key).alias("_n")))
    share, order = SPARE, Window.partitionBy(*(group or [F.lit(0)])).orderBy("_h", key)
    while True:
        # As doubles the bounds are rough, which is no matter: they only thin out what is ranked.
        reach = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(share * k)) / F.col("_n"))
        bounds = sizes.select(*group, F.when(F.col("_n") > share * k, reach).alias("_reach"))
        near = hashed.join(bounds, by) if by else hashed.withColumn("_reach", F.lit(bounds.first()["_reach"]).cast("double"))
        near = near.where("_reach IS NULL OR _h <= _reach").select(*group, key, "_h", "_reach").distinct()
        ranked = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
        found = materialise(ranked.select(*group, key, "_reach"))
        short = found.groupBy(*group).agg(F.count("*").alias("n"), F.max("_reach").alias("r")).where(f"n < {k} AND r IS NOT NULL")
        if not short.take(1) and (by is None or share > 1e6 or not bounds.where("_reach IS NOT NULL").join(found, by, "left_anti").take(1)):
            return found.drop("_reach")
        share *= 16

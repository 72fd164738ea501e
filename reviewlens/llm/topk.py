"""Exact top-k inner products by block-at-a-time pruning.

Rows are cut into blocks. For each term (a dimension and a sign) a block keeps the
largest weight that any of its rows has, so the sum over a query's terms of weight times maximum bounds
every score in the block. A query visits blocks in falling order of that bound, scores a block through
its forward index (its rows as one matrix), and stops at the first block whose bound lies below the k-th
score it has. Ties go to the smaller id, so a block whose bound equals the k-th score is still read.

On Spark, blocks are dealt in groups of bounded size and queries in batches of bounded size, and a task
meets one batch with one group. A first pass lets each batch score only the best-bound block of each
group; the k-th best score so found is a floor for the second pass, in which a group gives up
only rows that reach it. The last step keeps the k best rows of each query's few finalists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import materialise


@dataclass(frozen=True)
class TopKConfig:
    k: int = 20
    every: int = 20  # rows whose id is divisible by this are queries
    block_rows: int = 128
    group_rows: int = 16_384  # rows of the blocks that a task holds
    batch_queries: int = 1024  # queries that a task holds
    scale: int = 64  # weights are floor(scale * x)


def weights(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def stacked(vectors: list, width: int) -> np.ndarray:
    """Weights as one matrix; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, vector in enumerate(vectors):
        out[i, :len(vector)] = vector
    return out


class BlockIndex:
    """Forward index of one group: blocks of rows, and each block's least and largest weight by dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, block_rows: int) -> None:
        self.ids, self.rows, self.matrix = ids, rows, matrix
        self.starts = np.arange(0, len(ids), block_rows)
        self.high = np.maximum.reduceat(matrix, self.starts)
        self.low = np.minimum.reduceat(matrix, self.starts)
        self.ends = np.append(self.starts[1:], len(ids))
        # Sums stay exact in doubles below 2**53; beyond that integers are multiplied.
        widest = float(np.abs(matrix).max(initial=0))
        self.exact = widest * widest * max(matrix.shape[1], 1) < 2.0**52

    def scores(self, queries: np.ndarray, block: slice) -> np.ndarray:
        rows = self.matrix[block]
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64) if self.exact else queries @ rows.T

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and block a score that none of the block's rows exceeds."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        if self.exact:
            up, down = up.astype(float), down.astype(float)
        return up @ self.high.T.astype(up.dtype) + down @ self.low.T.astype(up.dtype)


def search(index: BlockIndex, query_rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int,
           first_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) arrays that hold each query's k best rows of the group reaching its floor."""
    bounds = index.bounds(queries)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    floors = floors.astype(float)
    active = np.arange(len(queries))
    for step in range(1 if first_only else len(index.starts)):
        block_of = order[active, step]
        # Bounds fall along a query's order, so one below the floor ends it.
        still = bounds[active, block_of] >= floors[active]
        active, block_of = active[still], block_of[still]
        if not len(active):
            break
        for block in np.unique(block_of).tolist():
            mine = active[block_of == block]
            span = slice(int(index.starts[block]), int(index.ends[block]))
            scores = index.scores(queries[mine], span)
            ids = index.ids[span]
            scores_ok = (scores >= floors[mine, None]) & (index.rows[span][None, :] != query_rows[mine, None])
            for q, row, ok in zip(mine.tolist(), scores, scores_ok):
                if not ok.any():
                    continue
                kept_ids = np.concatenate((best[q][0], ids[ok]))
                kept = np.concatenate((best[q][1], row[ok]))
                top = np.lexsort((kept_ids, -kept))[:k]
                best[q] = (kept_ids[top], kept[top])
                if len(top) == k:
                    floors[q] = max(floors[q], kept[top[-1]])
    counts = [len(x[0]) for x in best]
    if not sum(counts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.repeat(query_rows, counts), np.concatenate([x[0] for x in best]), np.concatenate([x[1] for x in best]))


def search_groups(config: TopKConfig, width: int, first_only: bool) -> callable:
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(rows) or not len(queries):
            return out
        rows = rows.sort_values("vec_id", kind="stable")
        index = BlockIndex(
            rows["vec_id"].to_numpy(), rows["row"].to_numpy(), stacked(rows["w"].tolist(), width), config.block_rows)
        found = search(index, queries["query"].to_numpy(), stacked(queries["asked"].tolist(), width),
                       queries["floor"].to_numpy(), config.k, first_only)
        return pd.DataFrame(dict(zip(out.columns, found)))
    return run


def top_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, config: TopKConfig = TopKConfig()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows (all, if fewer), ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; a row is no candidate of its own query.
    Vectors that are null or hold null, NaN or infinite components, and rows with a null vec_id, take no part.
    Vectors of different lengths meet as if the shorter ended in zeros. Rows that repeat a vec_id are rows of their
    own: each is a query if its id says so, and a candidate of all others. Columns other than vec_id and
    embedding are not read.
    """
    vectors = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), weights(F.col("embedding"), config.scale).alias("w"))
    vectors = materialise(vectors.withColumn("row", F.monotonically_increasing_id()))
    total, width = vectors.agg(F.count("*"), F.max(F.size("w"))).first()
    groups = max(1, -(-(total or 0) // config.group_rows))
    batches = max(1, -(-(total or 0) // (config.every * config.batch_queries)))
    # A hash deals rows to groups and queries to batches, so both hold what they should whatever the ids are.
    group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("long")
    every_batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    rows = vectors.select(group.alias("g"), every_batch.alias("b"), "row", "vec_id", "w")
    is_query = F.col("vec_id") % config.every == 0
    # A table of its own, so that rows and queries don't meet as two uses of one plan.
    queries = materialise(vectors.where(is_query).select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("w").alias("asked"),
        F.pmod(F.xxhash64("row", F.lit(2)), F.lit(batches)).cast("int").alias("b")))

    def visit(asked: DataFrame, first_only: bool) -> DataFrame:
        asked = asked.select(every_group.alias("g"), "b", "query", "asked", "floor")
        return rows.groupBy("g", "b").cogroup(asked.groupBy("g", "b")).applyInPandas(
            search_groups(config, max(width or 0, 1), first_only), "query bigint, vec_id bigint, score bigint")

    nothing = F.lit(-float("inf"))
    if groups > 1:
        seen = visit(queries.withColumn("floor", nothing), True)
        floors = top_rows(seen, config.k).where(F.col("rank") == config.k).select("query", F.col("score").alias("f"))
        queries = materialise(queries.join(materialise(floors), "query", "left").withColumn(
            "floor", F.coalesce(F.col("f").cast("double"), nothing)).drop("f"))
    else:
        queries = queries.withColumn("floor", nothing)
    best = top_rows(visit(queries, False), config.k)
    return best.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")

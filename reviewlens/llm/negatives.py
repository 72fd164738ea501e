"""Hard negatives by anchor-clustered shared lists.

Method. Anchors are clustered by direction. For a cluster with centre c whose members lie within an angle
t of c, no member of length 1 scores a row x above |x| cos(max(0, angle(x, c) - t)). Candidates are sorted
by that bound once per cluster, and every member walks this one list from the top, keeping the best rows it
wants, until the bound times its own length lies below the least score it can still use: all rows further
down are then certified to be of no use to it.

On Spark, rows lie in blocks of bounded size by direction, and a cluster's anchors in batches of bounded
size; a task holds one batch and one block and builds the shared list of the two. A small table holds a
bound for each batch and block; the rows of a block travel only to batches that can still use some of them.
A first visit of the block with the best bound gives every anchor floors for the second one.

The same walk serves positives (the best rows of the same label) and negatives (for each positive the best
rows of other labels within a window of scores). Centres are fitted on a bounded sample; they decide what
is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.topk import stacked, usable, weights
from reviewlens.session import materialise

LEAST = -(1 << 62)
# Angles are known to about 1e-8, products to 1e-15 of their size; bounds are raised by more than that.
ANGLE_SLACK = 1e-6
SLACK = 1e-9


@dataclass(frozen=True)
class MiningConfig:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # a negative scores at least so many hundredths of the positive,
    high: int = 95  # and at most so many
    every: int = 50  # rows whose id is divisible by this are anchors
    scale: int = 256  # weights are floor(scale * x)
    block_rows: int = 4096
    batch_anchors: int = 512
    most_centres: int = 64
    sample_rows: int = 8192  # rows that the centres are fitted on
    step: int = 256  # rows of a list that are scored at a time


def directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the rows as unit vectors; a zero row stays zero."""
    matrix = matrix.astype(float)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return norms, matrix / np.where(norms > 0, norms, 1.0)[:, None]


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a sample's directions, by spherical k-means from evenly spaced rows."""
    units = directions(sample)[1]
    units = units[(units != 0).any(axis=1)]
    if not len(units):
        units = np.eye(1, max(sample.shape[1], 1))
    centres = units[np.linspace(0, len(units) - 1, min(n, len(units))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(lengths[:, None] > 1e-9, sums / np.maximum(lengths, 1e-9)[:, None], centres)
    return centres


def bounds(norms: np.ndarray, apart: np.ndarray, spread: float) -> np.ndarray:
    """Scores per unit of the anchor's length that rows so far from a centre can't exceed."""
    return norms * np.cos(np.clip(apart - spread - ANGLE_SLACK, 0.0, np.pi))


class SharedList:
    """The candidates of a block, sorted once by their bound for one cluster of anchors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, matrix: np.ndarray,
                 centre: np.ndarray, spread: float) -> None:
        norms, units = directions(matrix)
        bound = bounds(norms, angles(units, centre[None, :])[:, 0], spread)
        order = np.argsort(-bound, kind="stable")
        self.bound = bound[order]
        self.ids, self.rows, self.labels, self.matrix = ids[order], rows[order], labels[order], matrix[order]
        self.widest = float(np.abs(matrix).max(initial=0))

    def scores(self, anchors: np.ndarray, part: slice) -> np.ndarray:
        rows = self.matrix[part]
        # Sums are exact in doubles below 2**53; beyond that integers are multiplied.
        if float(np.abs(anchors).max(initial=0)) * self.widest * max(anchors.shape[1], 1) < 2.0**52:
            return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
        return anchors @ rows.T

    def walk(self, anchors: np.ndarray, own_rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
             k: int, same_label: bool, step: int) -> tuple[list[tuple], int]:
        """(anchor, window, id, row, score) of the k best rows of each anchor's windows, and how many were scored.

        ``low`` and ``high`` hold one window of scores per column; a window with low above high is none.
        """
        lengths = directions(anchors)[0]
        floors = np.where(low <= high, low, np.iinfo(np.int64).max)
        least, most = floors.min(axis=1), np.where(low <= high, high, LEAST).max(axis=1)
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        active, scored = np.flatnonzero((low <= high).any(axis=1)), 0
        for begin in range(0, len(self.ids), step):
            reach = self.bound[begin] * lengths[active]
            # Bounds fall along the list, so an anchor that stops here has seen all it can use.
            active = active[reach + np.abs(reach) * SLACK + 1e-3 >= least[active]]
            if not len(active):
                break
            part = slice(begin, begin + step)
            scores = self.scores(anchors[active], part)
            scored += scores.size
            fits = (self.labels[part][None, :] == labels[active, None]) == same_label
            fits &= (scores >= least[active, None]) & (scores <= most[active, None])
            fits &= self.rows[part][None, :] != own_rows[active, None]
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                a, at = int(active[i]), np.flatnonzero(fits[i])
                got = scores[i, at]
                for w in np.flatnonzero(low[a] <= high[a]).tolist():
                    inside = (got >= floors[a, w]) & (got <= high[a, w])
                    if not inside.any():
                        continue
                    new = (got[inside], self.ids[part][at[inside]], self.rows[part][at[inside]])
                    if (a, w) in best:
                        new = tuple(map(np.concatenate, zip(best[a, w], new)))
                    top = np.lexsort((new[2], new[1], -new[0]))[:k]
                    best[a, w] = tuple(x[top] for x in new)
                    if len(top) == k:
                        floors[a, w] = max(floors[a, w], new[0][top[-1]])
                least[a] = floors[a].min()
        return [(a, w, i, r, s) for (a, w), (ss, ids, rows) in best.items()
                for s, i, r in zip(ss.tolist(), ids.tolist(), rows.tolist())], scored


def place_rows(centres: np.ndarray, cluster_centres: np.ndarray, width: int) -> Callable:
    """Norm, region and angle of each row, and the same for the anchor clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, units = directions(stacked(batch.column("w").to_pylist(), width))
            columns, names = [*batch.columns, pa.array(norms)], [*batch.schema.names, "norm"]
            for name, these in (("region", centres), ("cluster", cluster_centres)):
                apart = angles(units, these)
                nearest = apart.argmin(axis=1) if len(units) else np.zeros(0, int)
                columns += [pa.array(nearest.astype(np.int32)), pa.array(apart[np.arange(len(units)), nearest])]
                names += [name, f"{name}_angle"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


FOUND = "anchor_row bigint, anchor_id bigint, target int, found_id bigint, found_row bigint, score bigint"


def meet(config: MiningConfig, cluster_centres: np.ndarray, width: int, k: int, same_label: bool) -> Callable:
    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not len(rows) or not len(asked):
            return pd.DataFrame({n: pd.Series([], dtype="int32" if n == "target" else "int64") for n in names})
        centre = cluster_centres[int(asked["cluster"].iloc[0])]
        candidates = SharedList(
            rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy(),
            stacked(rows["w"].tolist(), width), centre, float(asked["cluster_angle"].max()))
        low, high = (np.stack(asked[name].tolist()).astype(np.int64) for name in ("low", "high"))
        found, _ = candidates.walk(
            stacked(asked["w"].tolist(), width), asked["row"].to_numpy(), asked["label"].to_numpy(),
            low, high, k, same_label, config.step)
        anchor_rows, anchor_ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        out = [(anchor_rows[a], anchor_ids[a], w, i, r, s) for a, w, i, r, s in found]
        return pd.DataFrame(out, columns=names).astype({n: "int32" if n == "target" else "int64" for n in names})
    return run


def best_found(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "target").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_number(values: list[int], number: str) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col(number) + 1)


class Index:
    """Rows in blocks by direction, anchors in batches by cluster, both of bounded size."""

    def __init__(self, vectors: DataFrame, config: MiningConfig) -> None:
        self.config = config
        spark = vectors.sparkSession
        is_anchor = F.col("vec_id") % config.every == 0
        total, n_anchors, width = vectors.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("w"))).first()
        self.width = max(width or 0, 1)
        # A sample of fixed size at most, however many rows there are.
        share = max(1, total // config.sample_rows)
        sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("w").limit(config.sample_rows).collect()
        sample = stacked([r["w"] for r in sample], self.width)
        regions = min(config.most_centres, -(-total // config.block_rows)) or 1
        clusters = min(config.most_centres, -(-n_anchors // config.batch_anchors)) or 1
        centres, self.cluster_centres = fit_centres(sample, regions), fit_centres(sample, clusters)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
        placed = materialise(vectors.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            place_rows(centres, self.cluster_centres, self.width),
            f"{kinds}, row bigint, norm double, region int, region_angle double, cluster int, cluster_angle double"))

        def dealt(table: DataFrame, group: str, name: str, size: int) -> tuple[DataFrame, int]:
            """Rows of a group dealt by hash to as many parts as it needs; parts are numbered through."""
            counts = {r[group]: r["n"] for r in table.groupBy(group).agg(F.count("*").alias("n")).collect()}
            parts = [-(-counts.get(i, 0) // size) for i in range(config.most_centres)]
            firsts = np.concatenate(([0], np.cumsum(parts))).tolist()
            number = by_number(firsts[:-1], group) + F.pmod(F.xxhash64("row"), by_number([max(p, 1) for p in parts], group))
            return table.withColumn(name, number.cast("long")), firsts[-1]

        blocks, self.n_blocks = dealt(placed, "region", "block", config.block_rows)
        self.rows = blocks.select("row", "vec_id", "label", "w", "block")
        # A table of its own, so that rows and anchors don't meet as two uses of one plan.
        self.anchors = materialise(dealt(placed.where(is_anchor), "cluster", "batch", config.batch_anchors)[0].select(
            "row", "vec_id", "label", "w", "norm", "batch", "cluster", "cluster_angle"))
        self.block_bounds = materialise(blocks.groupBy("block").agg(
            F.max("norm").alias("longest"), F.first("region").alias("region"), F.max("region_angle").alias("region_angle")))
        # At most most_centres rows squared.
        apart = angles(self.cluster_centres, centres)
        self.apart = spark.createDataFrame(
            [(c, r, float(apart[c, r])) for c in range(len(self.cluster_centres)) for r in range(len(centres))],
            "cluster int, region int, apart double")

    def pairs(self, asked: DataFrame) -> DataFrame:
        """(batch, block, bound) for all blocks that hold rows which some anchor of the batch can still use."""
        # The least floor per unit of length; windows that are none ask for nothing.
        least = F.array_min(F.transform(F.arrays_zip("low", "high"), lambda w: F.when(w["low"] <= w["high"], w["low"])))
        floor = F.when(F.col("norm") > 0, least / F.col("norm")).otherwise(F.lit(-float("inf")))
        batches = asked.where(least.isNotNull()).groupBy("batch").agg(
            F.first("cluster").alias("cluster"), F.max("cluster_angle").alias("spread"), F.min(floor).alias("floor"))
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(self.n_blocks, 1) - 1).cast("long")))
        met = batches.withColumn("block", every_block).join(self.block_bounds, "block").join(
            F.broadcast(self.apart), ["cluster", "region"])
        apart = F.col("apart") - F.col("spread") - F.col("region_angle") - F.lit(ANGLE_SLACK)
        bound = F.col("longest") * F.cos(F.greatest(apart, F.lit(0.0)))
        met = met.withColumn("bound", bound + F.abs(bound) * F.lit(SLACK) + F.lit(1e-3))
        return met.where(F.col("bound") >= F.col("floor")).select("batch", "block", "bound")

    def visit(self, asked: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
        pairs = materialise(pairs.select("batch", "block"))
        rows = self.rows.join(pairs, "block")
        members = asked.join(pairs, "batch")
        return rows.groupBy("batch", "block").cogroup(members.groupBy("batch", "block")).applyInPandas(
            meet(self.config, self.cluster_centres, self.width, k, same_label), FOUND)

    def search(self, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        """The k best rows in each of the anchors' windows (arrays low and high), as FOUND with a rank."""
        if self.n_blocks > 1:
            first = self.pairs(asked).groupBy("batch").agg(
                F.max_by("block", F.struct("bound", "block")).alias("block"))
            seen = best_found(self.visit(asked, first, k, same_label), k).where(F.col("rank") == k)
            floors = seen.groupBy("anchor_row").agg(
                F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("floors"))
            raised = F.transform("low", lambda low, w: F.greatest(low, F.coalesce(F.col("floors")[w], low)))
            asked = materialise(asked.join(materialise(floors).withColumnRenamed("anchor_row", "row"), "row", "left")
                                .withColumn("low", raised).drop("floors"))
        return best_found(self.visit(asked, self.pairs(asked), k, same_label), k)


def mine(embeddings: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its best other rows of
    the same label, and for each of them the negatives are the best rows of other labels that score between
    ``low`` and ``high`` hundredths of the positive; fewer where there are fewer. Ties go to the smaller vec_id.
    A negative positive_score leaves no such window.

    Rows with a null vec_id or label, or a vector that is null or holds null, NaN or infinite components, take
    no part. Vectors of different lengths meet as if the shorter ended in zeros. Rows that repeat a vec_id are rows
    of their own: each is an anchor, and a candidate of the others. Columns other than vec_id, embedding and
    label are not read. Scores must fit 64 bits.
    """
    vectors = embeddings.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        weights(F.col("embedding"), config.scale).alias("w"))
    index = Index(vectors, config)
    anything = {"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(-LEAST))}
    positives = materialise(index.search(index.anchors.withColumns(anything), config.positives, True))
    # At most config.positives rows per anchor.
    targets = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("t"))

    def limit(percent: int, up: int) -> F.Column:
        """score * percent / 100, rounded to the integers inside the window."""
        return F.transform("t.score", lambda s: F.floor(
            (s.cast("decimal(20,0)") * F.lit(percent) + F.lit(up)) / F.lit(100)).cast("long"))

    asked = materialise(index.anchors.join(targets.withColumnRenamed("anchor_row", "row"), "row").withColumns(
        {"low": limit(config.low, 99), "high": limit(config.high, 0)}).drop("t"))
    negatives = index.search(asked, config.negatives, False)
    of = positives.select("anchor_row", (F.col("rank") - 1).alias("target"), F.col("found_id").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor_row", "target"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

"""Shared storage, materialisation and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side up to this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Input that one part of a spread table holds, and how many parts a shuffle can have.
SPREAD_BYTES = 32 * 1024 * 1024
# The same where a part's rows are counted per document: a task then holds every known term of its documents.
COUNTED_BYTES = 8 * 1024 * 1024
MOST_PARTS = 100_000
# How many tasks one hot join key is spread over when a join has to shuffle.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a fresh temporary
    folder stands in for it in local mode only and goes when the process ends; on a cluster it
    would be another folder on every machine, so there the job stops.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="reviewlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_dir(spark)}/reviewlens/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, so lost executors cost no recompute.

    A written table beats a checkpoint of rows here: later reads take only the columns they
    need, and the planner knows its size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The planner's size of everything a plan reads; what it can't tell, such as rows in memory, counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def spread(df: DataFrame, keys: list[str], part_bytes: int | None = None) -> DataFrame:
    """Hash rows by key into parts of some ``part_bytes`` (SPREAD_BYTES) of input, spark.sql.shuffle.partitions at least.

    The number is given so that adaptive execution does not merge parts by their present
    size: the texts are exploded into many times their bytes right after.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(MOST_PARTS, -(-input_bytes(df) // (part_bytes or SPREAD_BYTES)))), *keys)


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and payload bytes of an already materialised table of flat columns."""
    width: Column = F.lit(0)
    for f in df.schema.fields:
        text = isinstance(f.dataType, T.StringType)
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(16) if text else F.lit(8))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def byte_size(df: DataFrame) -> int:
    return measure(df)[1]


def fits_broadcast(size_bytes: int) -> bool:
    """Whether ``join_by_size`` broadcasts a side of this size, unless it is given another limit."""
    return size_bytes <= BROADCAST_LIMIT_BYTES


def join_by_size(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    right_bytes: int,
    spread_by: list[str],
    limit: int | None = None,
) -> DataFrame:
    """Join with a small side whose measured size decides the strategy.

    Within ``limit`` the right side is broadcast. Beyond it both sides shuffle on the key
    plus a salt drawn from ``spread_by``, so that a key holding a large share of the left
    rows is worked on by many tasks. The result is the same. ``how`` is one of inner,
    left, left_semi and left_anti, for which repeating the right side per salt is exact.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot repeat its right side")
    if right_bytes <= (BROADCAST_LIMIT_BYTES if limit is None else limit):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")

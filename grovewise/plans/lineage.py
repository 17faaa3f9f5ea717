"""Helpers that keep iterative plans short and ids dense without a single-task sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a large table that one task sorts or adds up.
TASK_ROWS = 1 << 18


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one is set only where none is named (local tests)."""
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        here = spark.conf.get("spark.checkpoint.dir", None)
        if not here and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        here = here or tempfile.mkdtemp(prefix="grovewise-")
        spark.sparkContext.setCheckpointDir(here)
    return here


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by their keys, over as many tasks as so many rows ask for: a task's memory stays the same however many rows there are."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A side of a join, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def with_dense_id(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... by the order, which must be total.

    Rows are dealt to partitions by sampled ranges of the order, sorted there and checkpointed, so that a row's place in its
    partition is fixed. Only the partitions' counts meet in one task: no bucket of the caller's can be too large, or too many.
    """
    rows = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_offset") + place).drop("_at", "_part", "_offset")

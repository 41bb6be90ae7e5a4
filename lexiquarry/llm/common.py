"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that parts words, as a regex class and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, a local session (one machine, as in tests) gets a temporary
    folder; on a cluster that is an error, as executors don't share such folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "lexiquarry-checkpoints")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder; what the computation shuffled is deleted."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a new query, as the setting is read when it is made
    finally:
        spark.conf.set(CLEANUP, before)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Array of the words of text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def global_row_numbers(df: DataFrame, keys: list[str], buckets: int = 4096, by: list[str] | None = None) -> DataFrame:
    """One row per input row with its keys, `row_number` (0 to n - 1) and `n_rows`.

    Rows are counted by key first, so that a repeated row costs one counter; the
    distinct keys are dealt over a fixed number of hash buckets, numbered inside
    their bucket and shifted by the (few) bucket totals. Only the keys travel.
    The order is by hash, then by the keys: it doesn't depend on partitioning. The
    hash is of all keys, or of those in by.
    Rows equal in all keys are interchangeable and get adjacent numbers.
    """
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    grouped = grouped.withColumn("_h", F.xxhash64(*(by or keys))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    totals = grouped.groupBy("_b").agg(F.sum("_n").alias("_t"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_b", (F.sum("_t").over(upto) - F.col("_t")).alias("_base"), F.sum("_t").over(everything).alias("n_rows"))
    inside = Window.partitionBy("_b").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = grouped.withColumn("_start", F.sum("_n").over(inside) - F.col("_n")).join(F.broadcast(offsets), "_b")
    first = F.col("_base") + F.col("_start")
    return placed.select(*keys, "n_rows", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("row_number"))

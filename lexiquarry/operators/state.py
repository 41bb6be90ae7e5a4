"""Where results between rounds and scratch files lie."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a session on one machine gets a temporary folder; on
    a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexiquarry-")
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path inside the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()

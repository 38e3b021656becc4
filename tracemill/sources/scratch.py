"""Folders for tables that queries write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path under the shared ``spark.checkpoint.dir``; where that is unset a local one, but only under a
    local master: on a cluster, executors would write to disks of their own and rows would be missing."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} has no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracemill-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written and read again: the lineage ends there."""
    path = folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

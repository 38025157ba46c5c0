"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; only a session on one machine may go without, and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it several times plans and runs it once, and it survives the loss of executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

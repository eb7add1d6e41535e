"""Checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only for a local session where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder that all of the cluster sees, for tables and stream state of one run."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"

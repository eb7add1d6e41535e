"""Session set-up and access to the star-schema tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package.

    On a cluster that doesn't share it, ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.config('spark.ui.showConsoleProgress','false').master(f"local[{cores}]")
        .appName("larkspur")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; lazily, so that only the columns a query needs are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views for ``spark.sql``."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)

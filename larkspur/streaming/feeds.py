"""Change feeds and windowed event streams in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.writes import overwrite


def publication(changes: DataFrame, operations: list[str], columns: list[str] | None = None, row_filter: Column | None = None) -> DataFrame:
    """What a subscriber sees of a feed with columns ``op`` and ``seq``: chosen operations, rows and columns."""
    out = changes.where(F.col("op").isin(operations))
    if row_filter is not None:
        out = out.where(row_filter | (F.col("op") == "truncate"))
    return out if columns is None else out.select("op", "seq", *columns)


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key, after the last ``truncate``."""
    cut = changes.where("op = 'truncate'").agg(F.max("seq").alias("__cut"))
    live = changes.where("op <> 'truncate'").join(F.broadcast(cut)).where("__cut is null or seq > __cut").drop("__cut")
    by = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return live.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a batch of insert, update, delete and truncate changes."""
    last = latest(changes, keys)
    truncated = F.broadcast(changes.agg(F.count(F.when(F.col("op") == "truncate", 1)).alias("__t")))
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"t.{k}") == F.col(f"c.{k}"))
    kept = target.alias("t").join(last.alias("c"), match, "left_anti").join(truncated).where("__t = 0").select(*target.columns)
    return kept.unionByName(last.where("op <> 'delete'").select(*target.columns))


def subscribe(spark: SparkSession, feed: str, schema: T.StructType, table: str, keys: list[str], checkpoint: str, publish: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Apply a folder of change files to a Parquet table, one batch at a time.

    A batch is applied whole by one rename; the last change of a key wins, so a
    batch that runs again after a failure gives the same table.
    """

    def batch(changes: DataFrame, _: int) -> None:
        if not changes.isEmpty():
            overwrite(apply_changes(spark.read.parquet(table), changes, keys), table)

    stream = publish(spark.readStream.schema(schema).parquet(feed))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their sum by type in tumbling or sliding windows; the same plan for a stream and a table."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

"""Event-time windows over ``events``: tables here, and the same plans on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.checkpoints import scratch
from larkspur.plans import Query, frame
from larkspur.streaming.feeds import sessions, windowed_counts


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling counts by a stream that reads the table to its end, in update mode."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = scratch(spark)
    stream = spark.readStream.schema(schema).parquet(f"{path}*")  # a glob, as a stream reads folders
    events = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    last = rows.agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(last), "epoch").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


_TUMBLING = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

QUERIES: list[Query] = [
    frame("window_tumbling", "events", lambda e: windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz")), _TUMBLING),
    frame("window_sliding", "events", lambda e: windowed_counts(e, size="2 hours", slide="1 hour").withColumn("start", F.col("start").cast("timestamp_ntz")), """SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
        SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL"""),
    frame("window_session", "events", lambda e: sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"), """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""),
    Query("window_streamed", streamed, _TUMBLING),
]

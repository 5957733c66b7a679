"""Streaming queries and the update job, run to their end over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhoard.session import saved, shared_dir, table
from lexhoard.streaming.feeds import read_stream, stream_changed, stream_snapshot_changes


def _ended(stream: DataFrame) -> DataFrame:
    """The rows of a stream over all files there are."""
    at = f"{shared_dir(stream.sparkSession)}/lexhoard-stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def _landed(df: DataFrame) -> str:
    return saved(df).inputFiles()[0].rpartition("/")[0]


def stream_changed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; the second arrival is dropped unless its value differs, as for event_id % 10 = 0."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    again = events.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
    both = events.withColumn("arrival", F.lit(1)).union(again.withColumn("arrival", F.lit(2)))
    landed = _landed(both)
    schema = spark.read.parquet(landed).schema
    return _ended(stream_changed(read_stream(spark, landed, schema), "event_id", "ts", excludes=("arrival",))).select("event_id", "value")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of all events, which land in files by their hash, so that every batch holds late ones. A last file ends the stream:
    its one row, of a user of its own, lies so far ahead that the watermark passes all others."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    each = max(1, spark.sparkContext.defaultParallelism // 2)  # files of a third, so that all cores write and read
    landed = _landed(events.repartition(3 * each, F.xxhash64("ts", "user_id")))
    end = events.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    end.coalesce(1).write.mode("append").parquet(landed)
    return _ended(stream_snapshot_changes(read_stream(spark, landed, events.schema, 2 * each), "user_id", "ts", ["event_type", "value"], "60 days"))


def stream_snapshot_changes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _snapshots(spark, sf_dir).where(F.array_contains("changed_fields", "event_type"))
    return out.groupBy("user_id").agg(F.count("*").alias("n_changes"))


def stream_late_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with its version."""
    return _snapshots(spark, sf_dir).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "version", F.array_join("changed_fields", ",").alias("fields"))


QUERIES = {"stream_changed": stream_changed_events, "stream_snapshot_changes": stream_snapshot_changes_events, "stream_late_snapshots": stream_late_snapshots}
SQL = {
    "stream_changed": "SELECT event_id, value FROM events UNION ALL SELECT event_id, value + 1 FROM events WHERE event_id % 10 = 0",
    "stream_snapshot_changes": "SELECT user_id, count(*) AS n_changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS p FROM events) WHERE p IS NOT NULL AND p <> event_type GROUP BY 1",
    "stream_late_snapshots": """WITH p AS (SELECT user_id, ts, event_type, value, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type, value)),
q AS (SELECT *, (1 + sum((n > 1 AND (event_type IS DISTINCT FROM pt OR value IS DISTINCT FROM pv))::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_type, value ROWS UNBOUNDED PRECEDING))::INTEGER AS version FROM p)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "at", version, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM pt THEN 'event_type' END, CASE WHEN value IS DISTINCT FROM pv THEN 'value' END) AS fields
FROM q WHERE n > 1 AND (event_type IS DISTINCT FROM pt OR value IS DISTINCT FROM pv)""",
}

"""Task queues and their states as streams of (task_id, status, ts, ...); the same code reads static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: States that a task does not leave.
TERMINAL = ("completed", "failed", "cancelled")


def window_counts(requests: DataFrame, key: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each key and window; state goes once the watermark has passed a window."""
    return requests.withWatermark("ts", late).groupBy(key, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def first_within(tasks: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Tasks without repetitions of an id within ttl, after which ids are forgotten."""
    return tasks.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["task_id"])


def latest_states(events: DataFrame) -> DataFrame:
    """Each task's last status; a stream of it runs in update mode. Ties in ts go to the greater status."""
    return events.groupBy("task_id").agg(F.max(F.struct("ts", "status")).alias("_last")).select("task_id", F.col("_last.status").alias("status"), F.col("_last.ts").alias("ts"))


def kept(states: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """States but for those that ended more than ttl_seconds before now."""
    return states.filter(~(F.col("status").isin(*TERMINAL) & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") > ttl_seconds)))


def dequeued(spark: SparkSession, path: str, schema: StructType, queue: str | None = None, files: int = 1) -> DataFrame:
    """A stream of the tasks that sinks.enqueued() puts below path, files at a time, oldest first; keys that have ended are left out."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(path)
    rows = rows if queue is None else rows.filter(F.col("queue") == queue)
    return rows.filter(F.col("expires") > F.current_timestamp()) if "expires" in rows.columns else rows

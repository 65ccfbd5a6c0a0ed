"""Writers: append in files of a size, replacement of some tasks' rows, JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import folders, objects


def appended(rows: DataFrame, path: str, by: list[str] | None = None, most: int = 1_000_000) -> None:
    """Adds rows to a table; a file has most rows at the most."""
    writer = rows.write.mode("append").option("maxRecordsPerFile", most)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replaced_by_task(rows: DataFrame, path: str, key: str = "task_id") -> None:
    """Replaces the rows of the tasks that rows has; the table is partitioned by key, other tasks' files stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def without_task(rows: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return rows.join(tasks.select(key).distinct(), key, "left_anti")


def json_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """value: each row as a JSON object of columns, nulls left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def without_objects(rows: DataFrame, tasks: DataFrame, column: str, key: str = "task_id") -> DataFrame:
    """without_task(), and the objects that the rows taken out name in column are deleted, by calls of the driver's store, many at a time."""
    gone = rows.join(tasks.select(key).distinct(), key, "left_semi").filter(F.col(column).isNotNull()).select(column).distinct()
    objects.delete_all(rows.sparkSession, (row[0] for row in gone.toLocalIterator(prefetchPartitions=True)))
    return without_task(rows, tasks, key)


def enqueued(rows: DataFrame, path: str) -> None:
    """Adds tasks (queue, ...) to the queues below path, a folder each, from which dequeued() streams them."""
    rows.write.mode("append").partitionBy("queue").parquet(path)


class Delivery:
    """Hands batches of events to listeners, each of which gets all of them, in order, once it works.

    A batch is written below path before any listener sees it, and stays until all have had it; how far each has come is
    a small object of its own. A listener that raises is tried again with the next batch, or by redeliver(), from the batch that it
    failed on; the others go on. After a crash a listener may see again the batch that it was given last: batches carry their number.
    """

    def __init__(self, spark: SparkSession, path: str, listeners: dict[str, Callable[[DataFrame], None]]):
        self.spark, self.path, self.listeners = spark, path, listeners

    def _numbers(self) -> list[int]:
        return sorted(int(x) for x in folders.names(self.spark, f"{self.path}/batches"))

    def reached(self, name: str) -> int:
        """The number of the last batch that a listener has had; -1 for none."""
        done = [int(x) for x in folders.names(self.spark, f"{self.path}/reached/{name}")]
        return max(done, default=-1)

    def take(self, batch: DataFrame, number: int) -> None:
        """A batch of the stream; one that was taken before is not taken again."""
        if number > min((self.reached(n) for n in self.listeners), default=number):
            batch.write.mode("overwrite").parquet(f"{self.path}/batches/{number:012d}")
        self.redeliver()

    def redeliver(self) -> dict[str, str]:
        """Gives each listener what it has not had; the errors of those that fail."""
        errors, waiting = {}, self._numbers()
        for name, listener in self.listeners.items():
            done = self.reached(name)
            for number in (k for k in waiting if k > done):
                try:
                    listener(self.spark.read.parquet(f"{self.path}/batches/{number:012d}"))
                except Exception as e:
                    errors[name] = str(e)
                    break
                objects.put(self.spark, f"{self.path}/reached/{name}/{number:012d}", b"")
                if done >= 0:
                    objects.delete(self.spark, f"{self.path}/reached/{name}/{done:012d}")
                done = number
        least = min((self.reached(n) for n in self.listeners), default=-1)
        for number in waiting:
            if number <= least:
                objects.delete(self.spark, f"{self.path}/batches/{number:012d}")
        return errors

    def undelivered(self, name: str) -> DataFrame | None:
        """The events that a listener has not had, with the number of their batch; None where there are none."""
        left = [k for k in self._numbers() if k > self.reached(name)]
        out = None
        for k in left:
            own = self.spark.read.parquet(f"{self.path}/batches/{k:012d}").withColumn("batch", F.lit(k))
            out = own if out is None else out.unionByName(own)
        return out


def fan_out(events: DataFrame, listeners: list[Callable[[DataFrame], None]] | dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a stream that delivers each batch of events to all listeners; see Delivery, which keeps its files beside the checkpoint.

    Listeners without names go by their places.
    """
    named = listeners if isinstance(listeners, dict) else {str(k): x for k, x in enumerate(listeners)}
    delivery = Delivery(events.sparkSession, f"{checkpoint}-delivery", named)
    return events.writeStream.foreachBatch(delivery.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""States with memory: steps of tasks, and the last requests of a stage, kept between batches of a stream.

A key's rows of a batch come sorted by seq; what a batch leaves is read by the next one, after a restart too. State is held by
the store of the session (RocksDB), a row for each key or element, so a task's memory does not follow the keys. Rows of a key are
handled by one task, as each outcome depends on those before; keys are spread over all tasks.

Defined results: rows without a key are left out; a null status is an illegal step; rows behind the watermark (at first: of 1970 or before)
are left out; a batch of any size, and an empty one, gives the same rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.operators.tasks import STATES, STEPS, TERMINAL
from lattica.sources import folders

KEPT_SECONDS = 3600  # fixed value: an ended task's state goes after so long
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP_SCHEMA = "task_id string, seq long, was string, status string, legal boolean"
LAST_SCHEMA = "stage string, seq long, n_last long, sum_last long, ok_last long"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    whole = pd.concat(list(rows), ignore_index=True)
    return whole.sort_values("seq", kind="stable")


class _Steps(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else STATES[0]
        batch, was, legal, ends = _sorted(rows), [], [], None
        for status, at in zip(batch["status"], batch["ts"], strict=True):
            may = status in STEPS.get(now, ())
            was.append(now)
            legal.append(may)
            if may:
                now = status
                ends = at if now in TERMINAL else None
        if any(legal):
            self.state.update((now,))
            if ends is not None:
                self.handle.registerTimer(int(pd.Timestamp(ends).timestamp() * 1000) + 1000 * self.seconds)
        yield pd.DataFrame({"task_id": key[0], "seq": batch["seq"].to_numpy(), "was": was, "status": batch["status"].to_numpy(), "legal": legal})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"task_id": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "was": pd.Series([], dtype=str), "status": pd.Series([], dtype=str), "legal": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def stepped(changes: DataFrame, late: str = "1 minute", seconds: int = KEPT_SECONDS) -> DataFrame:
    """A stream of changes (task_id, seq, status, ts) with the state that each task is in, and whether the step is taken.

    A step that is not allowed is refused: the task stays where it was, in later batches too. A task that has ended is forgotten once
    the watermark (late behind the newest ts) is so many seconds past its end; it would then begin anew.
    """
    rows = changes.filter("task_id IS NOT NULL").select(F.col("task_id").cast("string").alias("task_id"), F.col("seq").cast("long").alias("seq"), "status", "ts").withWatermark("ts", late)
    return rows.groupBy("task_id").transformWithStateInPandas(statefulProcessor=_Steps(seconds), outputStructType=STEP_SCHEMA, outputMode="Append", timeMode="EventTime")


class _Last(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("last", "duration long, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = deque(((int(d), bool(ok)) for d, ok in self.kept.get()), maxlen=self.size)
        total, good = sum(d for d, _ in last), sum(ok for _, ok in last)
        batch, out = _sorted(rows), []
        for d, ok in zip(batch["duration"], batch["ok"], strict=True):
            d, ok = 0 if pd.isna(d) else int(d), bool(ok) and not pd.isna(ok)
            if len(last) == self.size:
                total, good = total - last[0][0], good - last[0][1]
            last.append((d, ok))
            total, good = total + d, good + ok
            out.append((len(last), total, good))
        self.kept.put(list(last))
        yield pd.DataFrame(out, columns=["n_last", "sum_last", "ok_last"]).assign(stage=key[0], seq=batch["seq"].to_numpy())[["stage", "seq", "n_last", "sum_last", "ok_last"]]

    def close(self) -> None:
        pass


def last_requests(log: DataFrame, size: int = 100) -> DataFrame:
    """A stream of requests (stage, seq, duration, ok) with counts and sums over their stage's last size ones, this one included.

    The last size requests of a stage are its state; a batch of any size gives what metrics.sliding() gives for the whole.
    """
    rows = log.filter("stage IS NOT NULL").select("stage", F.col("seq").cast("long").alias("seq"), F.col("duration").cast("long").alias("duration"), "ok")
    return rows.groupBy("stage").transformWithStateInPandas(statefulProcessor=_Last(size), outputStructType=LAST_SCHEMA, outputMode="Append", timeMode="None")


@contextmanager
def state_store(spark: SparkSession):
    """Streams that begin herein hold their state in RocksDB."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what its source has now, into Parquet files at path; the checkpoint carries it on next time."""
    with state_store(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def in_batches(rows: DataFrame, by: str, n: int, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows of a table dealt by ranges of a number into n batches of a stream, in order, and what run makes of that stream."""
    spark = rows.sparkSession
    source, out, checkpoint = (folders.new(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    least, most = rows.agg(F.min(by), F.max(by)).first()
    if least is None:
        rows.write.parquet(source)
    else:
        part = F.least(F.floor((F.col(by) - least) * n / (most - least + 1)), F.lit(n - 1))
        for k in range(n):
            rows.filter(part == k).coalesce(1).write.mode("append").parquet(source)
    drained(run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)), out, checkpoint)
    for path in (source, out, checkpoint):
        folders.deleted_at_exit(spark, path)
    return spark.read.parquet(out)

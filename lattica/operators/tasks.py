"""Queues of tasks, their states, permits, limits and events: (task_id, queue, priority, status, created, ...) rows."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import order as O
from lattica.sources import folders

#: States, the steps between them, states that end, and seconds of keys, runs and waits.
STATES = ("pending", "queued", "running", "completed", "failed", "cancelled")
STEPS = {"pending": ("queued", "cancelled"), "queued": ("running", "cancelled"), "running": ("completed", "failed", "cancelled")}
TERMINAL = ("completed", "failed", "cancelled")
KEY_SECONDS, HARD_SECONDS, SOFT_SECONDS, STARTS_A_MINUTE, WAIT_SECONDS, MOST_WAITS, EVENTS = 24 * 3600, 600, 540, 10, 30, 3, 1000


def enqueued(tasks: DataFrame, seconds: int = KEY_SECONDS) -> DataFrame:
    """Tasks with the queue of their kind, and when their key ends."""
    return tasks.withColumn("queue", T.queue_name(F.col("kind"))).withColumn("expires", F.col("created") + F.make_dt_interval(secs=F.lit(seconds)))


def alive(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.filter(F.col("expires") > now)


def dequeued(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The n tasks that each queue gives first, first in first out."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy("created", "task_id"))
    return tasks.withColumn("k", place).filter(F.col("k") <= n)


def with_status(tasks: DataFrame, status: str | None = None, task_id=None) -> DataFrame:
    """Tasks of a status and an id, as far as they are given."""
    out = tasks if status is None else tasks.filter(F.col("status") == status)
    return out if task_id is None else out.filter(F.col("task_id") == task_id)


def page_of(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the total of all of them."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def status_counts(tasks: DataFrame, by: str, states: tuple = STATES) -> DataFrame:
    """A column for each state, and the total, of each value of by."""
    return tasks.groupBy(by).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def duration(created: Column, completed: Column, now: Column) -> Column:
    """Seconds from creation to the end, or to now for what has not ended."""
    return F.unix_timestamp(F.coalesce(completed, now).cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))


def walked(changes: DataFrame) -> DataFrame:
    """Changes of state (task_id, seq, status) with the state before and whether the step may be taken; a task begins pending."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("task_id").orderBy("seq")), F.lit(STATES[0]))
    legal = F.lit(False)
    for old, new in STEPS.items():
        legal = legal | ((F.col("was") == old) & F.col("status").isin(*new))
    return changes.withColumn("was", before).withColumn("legal", legal)


def events(changes: DataFrame) -> DataFrame:
    """The event of each change of state that has one: started, completed with all progress, or failed with its error."""
    kind = F.when(F.col("status") == "running", "started").when(F.col("status").isin("completed", "failed"), F.col("status"))
    progress = F.when(F.col("status") == "completed", 100.0).when(F.col("status") == "running", 0.0)
    return changes.withColumn("event", kind).filter("event is not null").withColumn("progress", progress).withColumn("message", F.when(F.col("event") == "failed", F.col("error")))


def progress_event(task_id: Column, share: Column, message: Column) -> Column:
    return F.struct(task_id.alias("task_id"), F.lit("progress").alias("event"), share.alias("progress"), message.alias("message"))


def granted(requests: DataFrame, limits: dict[str, int], default: int = 1) -> DataFrame:
    """Requests (kind, begin, end) with granted: a kind has at most limits[kind] of them open; who finds none free is refused.

    The limit bounds the state that is held.
    """

    def step(open_, row):
        while open_ and open_[0] <= row.begin:
            heapq.heappop(open_)
        if len(open_) >= limits.get(row.kind, default):
            return (False,)
        heapq.heappush(open_, row.end)
        return (True,)

    return O.folded(requests, "kind", ["begin", "end"], list, step, "granted boolean")


def arrival_windows(requests: DataFrame, seconds: int = 60, width: int = 1024) -> DataFrame:
    """Requests (kind, at in whole seconds) with the window they fall into: it begins with the first request after the last one's end.

    Adds window_start and n_in_window (the request's place in it; requests of one second are in no fixed order). A null kind is a
    kind; a request without a time is in no window: both are null.

    A kind's seconds are cut into ranges of width windows' length. Each range tells, by itself, in which window it ends for each
    second at which a first window may begin in it (those of one window's length, at most); one row a range is then handed on from range to
    range, and all ranges place their seconds. So no task sees the requests of a kind, only the seconds of one range of it.
    """
    names, long = requests.columns, width * seconds
    timed = requests.filter(F.col("at").isNotNull()).withColumn("_tie", F.monotonically_increasing_id())
    placed = O.running(timed, ["kind"], ["at", "_tie"], F.lit(1).cast("long"), "_place")
    moments = folders.written(placed.groupBy("kind", "at").agg(F.min("_place").alias("_first")).withColumn("_range", F.floor(F.col("at") / long)), "moments")

    def ends(at: np.ndarray) -> np.ndarray:
        """For each second, the last start of the windows that begin with it."""
        after, out = np.searchsorted(at, at + seconds).tolist(), at.tolist()
        for k in range(len(at) - 1, -1, -1):
            if after[k] < len(at):
                out[k] = out[after[k]]
        return np.array(out, np.int64)

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(rows["at"].to_numpy(np.int64))
        most = int(np.searchsorted(at, key[1] * long + seconds)) + 1
        return pd.DataFrame({"kind": [key[0]], "_range": [key[1]], "enter_at": [at[:most].tolist()], "leave_at": [ends(at)[:most].tolist()]})

    def hand_on(last, row):
        before = last[0]
        k = 0 if before is None else bisect_left(row.enter_at, before + seconds)
        if k < len(row.enter_at):
            last[0] = row.leave_at[k]
        return (before,)

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at, start = rows["at"].to_numpy(np.int64), rows["_before"].iloc[0]
        out, k = np.empty(len(at), np.int64), 0
        while k < len(at):
            start = at[k] if pd.isna(start) or at[k] >= start + seconds else start
            end = int(np.searchsorted(at, start + seconds))
            out[k:end], k = start, end
        return rows.assign(window_start=out)[["kind", "at", "_first", "window_start"]]

    kind = f"kind {requests.schema['kind'].dataType.simpleString()}"
    ranges = moments.groupBy("kind", "_range").applyInPandas(table, f"{kind}, _range long, enter_at array<long>, leave_at array<long>")
    begun = O.folded(ranges, "kind", ["_range"], lambda: [None], hand_on, "_before long").select(F.col("kind").alias("_kind"), F.col("_range").alias("_of"), "_before")
    met = moments.join(begun, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("_range") == F.col("_of"))).select("kind", "at", "_first", "_range", "_before")
    own = folders.written(met.groupBy("kind", "_range").applyInPandas(place, f"{kind}, at long, _first long, window_start long"), "windows")
    starts = own.filter("at = window_start").select(F.col("kind").alias("_kind"), F.col("at").alias("_start"), F.col("_first").alias("_zero"))
    windows = own.join(starts, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("window_start") == F.col("_start"))).select(F.col("kind").alias("_own"), F.col("at").alias("_at"), "window_start", "_zero")
    out = placed.join(windows, F.col("kind").eqNullSafe(F.col("_own")) & (F.col("at") == F.col("_at")))
    untimed = requests.filter(F.col("at").isNull()).select(*names, F.lit(None).cast("long").alias("window_start"), F.lit(None).cast("long").alias("n_in_window"))
    return out.select(*names, "window_start", (F.col("_place") - F.col("_zero") + 1).alias("n_in_window")).unionByName(untimed)


def bounded_queue(arrivals: DataFrame, capacity: int = EVENTS) -> DataFrame:
    """Events (kind, at, took) with dropped: they are handled one after another, and one that finds capacity waiting is dropped."""

    def step(ends, row):
        while ends and ends[0] <= row.at:
            ends.popleft()
        # The first one is being handled, the others wait.
        if len(ends) > capacity:
            return (True,)
        ends.append(max(row.at, ends[-1] if ends else row.at) + row.took)
        return (False,)

    return O.folded(arrivals, "kind", ["at"], deque, step, "dropped boolean")


def run_limits(runs: DataFrame, soft: int = SOFT_SECONDS, hard: int = HARD_SECONDS) -> DataFrame:
    """Runs (seconds) with their outcome and the seconds they get: warned beyond the soft limit, killed at the hard one."""
    s = F.col("seconds")
    return runs.withColumn("outcome", F.when(s >= hard, "killed").when(s >= soft, "warned").otherwise("finished")).withColumn("given", F.least(s, F.lit(hard)))


def wait_seconds(attempt: Column, limited: Column) -> Column:
    """Seconds to wait before the next try of a task that met a rate limit; null where there is none."""
    return F.when(limited & attempt.between(1, MOST_WAITS), attempt * WAIT_SECONDS)


def health(checks: DataFrame, seconds: int = 30) -> DataFrame:
    """Of each provider and poll (one each so many seconds): whether the last check went well, and the counts since the poll before."""
    poll = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("long")
    return checks.groupBy("provider", poll.alias("poll")).agg(F.max_by("ok", F.struct("ts", "seq")).alias("available"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors"))

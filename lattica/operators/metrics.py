"""Metrics and control rules over request logs and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import order as O

def stage_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.sum("duration").alias("sum_duration"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors"))


def sliding(log: DataFrame, size: int = 100) -> DataFrame:
    """Counts and sums over each stage's last size requests; a stage's requests are dealt to blocks that know the size ones before."""

    def columns(window):
        last = window.rowsBetween(1 - size, 0)
        return {"n_last": F.count(F.lit(1)).over(last), "sum_last": F.sum("duration").over(last), "ok_last": F.sum(F.col("ok").cast("int")).over(last)}

    return O.over_frame(O.numbered(log, ["stage"], F.col("seq"), name="_n"), ["stage"], columns, before=size - 1, name="_n").drop("_n")


#: Rates and seconds at which concurrency steps up or down, and its bounds.
def next_concurrency(now: Column, success: Column, error: Column, seconds: Column, up: float = 0.95, down: float = 0.2, least: int = 1, most: int = 10) -> Column:
    return F.when((success >= up) & (seconds < 3), F.least(now + 1, F.lit(most))).when((error >= down) | (seconds > 8), F.greatest(now - 1, F.lit(least))).otherwise(now)


def periods(log: DataFrame, unit: str = "hour") -> DataFrame:
    """Requests, successes, errors, tokens and cost of each hour or day; a log without tokens or cost has none."""
    more = [F.sum(c).alias(c) for c in ("tokens", "cost") if c in log.columns]
    return log.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors"), F.sum("duration").alias("sum_duration"), *more)


def error_distribution(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("ok")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def success_rate(log: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("ok"), 1))
    return log.agg(F.count(F.lit(1)).alias("total"), ok.alias("n_ok"), (F.count(F.lit(1)) - ok).alias("n_errors"), F.coalesce(ok / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("success_rate"))


def latency(log: DataFrame, key: str) -> DataFrame:
    """Successes, errors and mean duration of each key's requests."""
    return log.groupBy(key).agg(F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors"), F.avg("duration").alias("mean_duration"))


def concurrency_totals(tasks: DataFrame) -> DataFrame:
    """Sums over task types of their concurrency and share of the request quota, and the types over their own limit."""
    return tasks.agg(F.sum("concurrency").alias("total_concurrency"), F.sum("rpm_share").alias("total_rpm_share"), F.count(F.when(F.col("concurrency") > F.col("max_concurrent"), 1)).alias("n_over"))


#: Shares of a quota over which a report warns, and the least milliseconds between requests.
HIGH_SHARE, SHORT_MS = 0.8, 100


def config_report(allocations: DataFrame, max_rpm: int, max_concurrent: int) -> DataFrame:
    """Requests a minute of each task type (task_type, rpm_share, max_concurrent, interval_ms), and what is wrong with it."""
    wrong = F.array_compact(F.array(F.when(~F.col("rpm_share").between(0, 1) | (F.col("rpm_share") == 0), "share"), F.when(F.col("max_concurrent") <= 0, "concurrent"), F.when(F.col("interval_ms") <= 0, "interval")))
    return allocations.select("task_type", (F.col("rpm_share") * max_rpm).alias("rpm"), "max_concurrent", wrong.alias("errors"), (F.col("interval_ms") < SHORT_MS).alias("short_interval"))


def config_warnings(allocations: DataFrame, max_concurrent: int) -> DataFrame:
    """Totals of all task types, whether they are over the quotas, and whether they come near them."""
    share, n = F.sum("rpm_share"), F.sum("max_concurrent")
    return allocations.agg(share.alias("total_share"), n.alias("total_concurrent"), (share > 1).alias("share_over"), (n > max_concurrent).alias("concurrent_over"), (share > HIGH_SHARE).alias("high_share"), (n > max_concurrent * 8 // 10).alias("high_concurrent"))


def first_available(tasks: DataFrame, providers: DataFrame, default: str | None = None) -> DataFrame:
    """Adds provider: the first of a task's list (providers) that is available, else default; providers has name, available."""
    listed = tasks.select("task_id", F.posexplode("providers").alias("_k", "_name")).join(providers.filter("available").select(F.col("name").alias("_name")), "_name")
    picked = listed.groupBy("task_id").agg(F.min_by("_name", "_k").alias("provider"))
    return tasks.join(picked, "task_id", "left").withColumn("provider", F.coalesce("provider", F.lit(default)))


def provider_names(providers: DataFrame) -> DataFrame:
    return providers.select("name").distinct().orderBy("name")


def best_provider(providers: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Each key's provider with the highest weighted sum of columns; the least name of those that tie."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    top = providers.groupBy(key).agg(F.min(F.struct((-score).alias("s"), "name")).alias("_top"))
    return top.select(key, F.col("_top.name").alias("name"), (-F.col("_top.s")).alias("score"))


def recent(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def fixed_windows(log: DataFrame, seconds: int = 60, most: int = 60) -> DataFrame:
    """Requests of each stage and window, and how many are over the limit."""
    start = (F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds).cast("long") * seconds
    return log.groupBy("stage", start.alias("window_start")).agg(F.count(F.lit(1)).alias("n")).withColumn("n_over", F.greatest(F.col("n") - most, F.lit(0)))


def too_soon(log: DataFrame, seconds: int) -> DataFrame:
    """Requests that come less than so many seconds after the one before of their stage."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = O.numbered(log, ["stage"], F.col("seq"), name="_n")
    return O.over_frame(rows, ["stage"], lambda w: {"gap": at - F.lag(at).over(w)}, before=1, name="_n").drop("_n").filter(F.col("gap") < seconds)


def peak_overlap(spans: DataFrame) -> DataFrame:
    """The most spans [begin, end) of a kind that were open at once."""
    marks = spans.select("kind", F.col("begin").alias("at"), F.lit(1).alias("d")).unionByName(spans.select("kind", F.col("end").alias("at"), F.lit(-1).alias("d")))
    return O.peak(marks, ["kind"], F.col("at"), F.col("d"))


def batches(rows: DataFrame, key: str, order: str, size: int, ties: list | tuple = ()) -> DataFrame:
    """Adds batch: each key's rows by a whole number and ties, in lots of size."""
    return O.numbered(rows, [key], F.col(order), ties, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def round_robin(rows: DataFrame, key: str, order: str, kinds: tuple, ties: list | tuple = ()) -> DataFrame:
    """Adds kind: each key's rows take the kinds in turn."""
    turn = batches(rows, key, order, 1, ties)
    return turn.withColumn("kind", F.get(F.array(*map(F.lit, kinds)), F.pmod("batch", F.lit(len(kinds))).cast("int"))).drop("batch")


#: Priorities as they compare, by name.
def by_priority(tasks: DataFrame) -> list[Column]:
    return [F.desc("priority"), F.asc("created"), F.asc("task_id")]


def popped(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The n tasks of each queue that come next."""
    return tasks.withColumn("k", F.row_number().over(Window.partitionBy("queue").orderBy(*by_priority(tasks)))).filter(F.col("k") <= n)


def best_head(tasks: DataFrame) -> DataFrame:
    return popped(tasks).orderBy(*by_priority(tasks), "queue").limit(1)


def latest_state(events: DataFrame) -> DataFrame:
    """Each task's last status; of equal seq the greater one."""
    return events.groupBy("task_id").agg(F.max(F.struct("seq", "status"))["status"].alias("status"), F.count(F.lit(1)).alias("n_events"))


def routed(tasks: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    """Tasks that meet all rules (field, eq|gt|lt|gte|lte|in, value)."""
    ops = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(v)}
    for field, op, value in rules:
        tasks = tasks.filter(ops[op](F.col(field), value))
    return tasks


def failed_too_often(rows: DataFrame) -> DataFrame:
    """Stages with failures in more than half of their requests, halves rounded down."""
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("n_errors")).withColumn("failed", F.col("n_errors") > F.floor(F.col("n") / 2))

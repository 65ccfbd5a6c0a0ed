"""Versioned category rows: (task_id, code, ..., batch_id, batch_ts, is_current)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLETE_ROWS = 1000  # fixed value: a version of more rows is complete


def history(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id", "batch_id", "batch_ts", "is_current").agg(F.count(F.lit(1)).alias("n_rows"))


def latest_complete(rows: DataFrame, least: int = COMPLETE_ROWS) -> DataFrame:
    """task_id, batch_id of each task's newest version of more than least rows."""
    return history(rows).filter(F.col("n_rows") > least).groupBy("task_id").agg(F.max_by("batch_id", F.struct("batch_ts", "batch_id")).alias("batch_id"))


def resolved(rows: DataFrame, least: int = COMPLETE_ROWS) -> DataFrame:
    """The rows of each task's latest complete version, or its current ones where it has none."""
    best = latest_complete(rows, least).withColumnRenamed("batch_id", "_best")
    return rows.join(best, "task_id", "left").filter(F.when(F.col("_best").isNotNull(), F.col("batch_id") == F.col("_best")).otherwise(F.col("is_current"))).drop("_best")


def current(rows: DataFrame, task_id=None) -> DataFrame:
    out = rows.filter("is_current")
    return (out if task_id is None else out.filter(F.col("task_id") == task_id)).orderBy("task_id", "code")


def by_batch(rows: DataFrame, batch_id) -> DataFrame:
    return rows.filter(F.col("batch_id") == batch_id).orderBy("code")


def children_of(rows: DataFrame, parent: str, batch_id=None) -> DataFrame:
    out = rows.filter(F.col("parent_code") == parent)
    return (out.filter("is_current") if batch_id is None else out.filter(F.col("batch_id") == batch_id)).orderBy("code")


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after an upload: current rows of the tasks uploaded are demoted, the new ones are current."""
    tasks = new.select("task_id").distinct().withColumn("_new", F.lit(True))
    old = rows.join(tasks, "task_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(new.withColumn("is_current", F.lit(True)))


def replaced(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with those of the new rows' tasks taken out and the new ones put in."""
    return rows.join(new.select("task_id"), "task_id", "left_anti").unionByName(new)


def stamped(new: DataFrame, batch_id, batch_ts) -> DataFrame:
    """New rows with the version's fields filled in where they have none, and current."""
    has = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in new.columns else F.lit(v)
    return new.withColumns({"batch_id": has("batch_id", batch_id), "batch_ts": has("batch_ts", batch_ts), "is_current": F.lit(True)})


def by_status(rows: DataFrame, task_id, status: str) -> DataFrame:
    return rows.filter((F.col("task_id") == task_id) & (F.col("status") == status)).orderBy("code")


def unfilled(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col(column), F.lit("")) == "")


def filled(rows: DataFrame, better: DataFrame, column: str) -> DataFrame:
    """Rows whose column is empty take it from better's row of the code; others stay as they are."""
    own = better.groupBy("code").agg(F.min(F.nullif(F.col(column), F.lit(""))).alias("_new"))
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    return rows.join(own, "code", "left").withColumn(column, F.when(empty, F.coalesce("_new", F.col(column))).otherwise(F.col(column))).select(*rows.columns)


def updated(rows: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with non-null columns of changes set, by task and code; one change a key."""
    own = changes.select("task_id", "code", *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(own, ["task_id", "code"], "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def deleted(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    return rows.join(tasks.select("task_id"), "task_id", "left_anti")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def recent_limit(limit: int | None) -> int:
    """10 unless from 1 to 50."""
    return limit if limit is not None and 1 <= limit <= 50 else 10


def first_of_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def status_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

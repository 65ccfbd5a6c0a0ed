"""Places, frames and folds over ordered rows whose keys may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources import folders


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of value over the rows of the same keys that come before, by columns of any type.

    Rows are dealt by ranges of keys and order together, so that a hot key is many tasks; a range's rows are summed up by themselves
    and shifted by the sums of the key's ranges before. Null keys are a key; rows that tie in order are in no fixed order.
    The rows with their ranges are written once, as ranges are drawn anew in each run.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_value", value).repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id())
    dealt = folders.written(dealt, "ranges")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    shift = sums.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy("_part"))), F.lit(0)).alias("_shift"))
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(before(Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))), F.lit(0)))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_of"))
    return own.join(shift, same).select(*rows.columns, (F.col("_own") + F.col("_shift")).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: Column, ties: list | tuple = (), name: str = "n", width: int = 1 << 16) -> DataFrame:
    """Adds each row's place (from 1) among those of its keys, by a whole number and then ties.

    Rows are placed within ranges of width numbers, a task each, and shifted by the counts of the ranges before, so
    one key's rows meet in no task; only a count for each range does. A null key is a key, and null numbers come first.
    """
    ranged = rows.withColumn("_range", F.floor(order / F.lit(width)))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = [*keys, "_range"]
    shift = counts.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(own)], F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(order, *ties))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(own)])
    return ranged.withColumn("_place", place).join(shift, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_place") + F.col("_shift")).alias(name))


def framed(rows: DataFrame, before: int = 0, after: int = 0, name: str = "n", size: int = 1 << 12) -> DataFrame:
    """Deals numbered rows to blocks of size places, with copies of the rows just before and after each (own is false for them)."""
    place = F.col(name) - 1
    block, spot = F.floor(place / size), F.pmod(place, F.lit(size))
    copies = F.array_compact(F.array(block, F.when(spot >= size - before, block + 1), F.when((spot < after) & (block > 0), block - 1)))
    return rows.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == block)


def over_frame(rows: DataFrame, keys: list[str], columns: Callable[[object], dict[str, Column]], before: int = 0, after: int = 0, name: str = "n", size: int = 1 << 12) -> DataFrame:
    """Adds columns(window), where window orders a block's rows by place; what they look at lies within before and after rows."""
    window = Window.partitionBy(*keys, "_block").orderBy(name)
    out = framed(rows, before, after, name, size)
    return out.withColumns(columns(window)).filter("_own").drop("_block", "_own")


def peak(rows: DataFrame, keys: list[str], order: Column, change: Column, name: str = "peak", width: int = 1 << 16) -> DataFrame:
    """The highest running sum of change over each key's rows, in ranges of width numbers that are summed up by themselves first."""
    steps = rows.groupBy(*keys, order.alias("_at")).agg(F.sum(change).alias("_d")).withColumn("_range", F.floor(F.col("_at") / F.lit(width)))
    local = F.sum("_d").over(Window.partitionBy(*keys, "_range").orderBy("_at"))
    ranges = steps.withColumn("_open", local).groupBy(*keys, "_range").agg(F.max("_open").alias("_most"), F.sum("_d").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).groupBy(*keys).agg(F.max(F.col("_shift") + F.col("_most")).alias(name))


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple], added: str) -> DataFrame:
    """Adds the columns of added (a DDL schema), by a fold over each key's rows in order.

    step(state, row) returns their values; the state begins as start(). A key's rows are read as a stream by one task,
    which holds one batch and one state: a fold is sequential, as each row's outcome depends on those before.
    """
    names = [x.split()[0] for x in added.split(",")]

    def run(batches: Iterator[pd.DataFrame]):
        at, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                if not begun or not (own == at or (pd.isna(own) and pd.isna(at))):
                    at, state, begun = own, start(), True
                out.append(step(state, row))
            yield batch.assign(**{n: [x[k] for x in out] for k, n in enumerate(names)})

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), added])
    return sorted_rows.mapInPandas(run, schema)

"""Queries over tables that Spark writes from the driver's tables first: sheets, committed versions, and batches of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import answers as A
from lattica.operators import tasks as K
from lattica.plans import views as W
from lattica.plans.queries import _query
from lattica.sources import committed, folders, sinks, xlsx
from lattica.streaming import states as S

_V = f"WITH {W.VERSIONS_SQL}"


def _sheets(spark: SparkSession, d: str) -> str:
    path = folders.new(spark, "sheets")
    xlsx.write_sheets(W.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("o_orderstatus")), path, 20_000)
    folders.deleted_at_exit(spark, path)
    return path


@_query("src01_sheet_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice::DOUBLE AS o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    cells = xlsx.sheet_rows(spark, _sheets(spark, d), pattern="part-*").select("cells")
    cell = lambda k: F.get("cells", F.lit(k))
    return cells.select(cell(0).cast("long").alias("o_orderkey"), cell(1).alias("o_orderpriority"), cell(2).cast("double").alias("o_totalprice"), F.nullif(cell(3), F.lit("")).alias("o_orderstatus"))


@_query("src01_sheet_columns", "SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _(spark, d):
    rows = xlsx.sheet_rows(spark, _sheets(spark, d), columns=["A", "B"], pattern="part-*")
    return rows.groupBy(F.col("B").alias("o_orderpriority")).agg(F.count("*").alias("n"), F.sum(F.col("A").cast("long")).alias("keys"))


def _years(spark: SparkSession, d: str) -> str:
    """A table with a version for each year's orders, oldest first."""
    path, rows = folders.new(spark, "versions"), W.versions(spark, d).select("task_id", "code", "name", "batch_id", "status")
    for year in sorted(r.batch_id for r in rows.select("batch_id").distinct().collect()):
        committed.write(rows.filter(F.col("batch_id") == year), path)
    folders.deleted_at_exit(spark, path)
    return path


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id", "batch_id", "is_current").agg(F.count(F.lit(1)).alias("n"))


@_query("snk02_committed_versions", f"{_V} SELECT task_id, batch_id, is_current, count(*) AS n FROM v GROUP BY ALL")
def _(spark, d):
    return _counts(committed.read(spark, _years(spark, d)))


@_query("snk02_older_version", f"{_V}, w AS (SELECT *, dense_rank() OVER (ORDER BY batch_id) AS k FROM v), x AS (SELECT *, batch_id = max(batch_id) OVER (PARTITION BY task_id) AS now FROM w WHERE k <= 3) SELECT task_id, batch_id, now AS is_current, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    return _counts(committed.read(spark, _years(spark, d), 3))


@_query("snk03_committed_replacement", f"{_V} SELECT task_id, batch_id, is_current, count(*) AS n FROM v WHERE task_id >= 10 GROUP BY ALL UNION ALL SELECT task_id, 0, true, count(*) FROM v WHERE task_id < 10 AND is_current GROUP BY 1")
def _(spark, d):
    path = _years(spark, d)
    committed.write(committed.read(spark, path).filter("is_current AND task_id < 10").drop("version", "is_current").withColumn("batch_id", F.lit(0)), path, "replace")
    return _counts(committed.read(spark, path))


@_query("snk04_committed_update", f"{_V} SELECT task_id, code, status, batch_id FROM v WHERE NOT is_current UNION ALL SELECT task_id, code, CASE WHEN task_id % 5 = 3 AND status = 'O' THEN 'done' ELSE status END, batch_id FROM v WHERE is_current")
def _(spark, d):
    path = _years(spark, d)
    changes = committed.read(spark, path).filter("is_current AND task_id % 5 = 3 AND status = 'O'").select("task_id", "code", F.lit("done").alias("status"))
    committed.changed(spark, path, changes, ["status"], ["task_id", "code"])
    return committed.read(spark, path).select("task_id", "code", "status", "batch_id")


def _legal(was: str, status: str) -> str:
    return " OR ".join(f"({was} = '{old}' AND {status} IN ({', '.join(repr(x) for x in new)}))" for old, new in K.STEPS.items())


@_query("sm04_stateful_steps", f"""WITH RECURSIVE o AS (SELECT user_id AS task_id, event_id AS seq, {list(K.STATES)!r}[event_id % 6 + 1] AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT task_id, r, seq, status, 'pending' AS was FROM o WHERE r = 1 UNION ALL SELECT o.task_id, o.r, o.seq, o.status, CASE WHEN {_legal("f.was", "f.status")} THEN f.status ELSE f.was END FROM f JOIN o ON o.task_id = f.task_id AND o.r = f.r + 1)
SELECT seq, was, status, {_legal("was", "status")} AS legal FROM f""")
def _(spark, d):
    status = F.get(F.array(*map(F.lit, K.STATES)), (F.col("event_id") % 6).cast("int"))
    changes = W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return S.in_batches(changes, "seq", 3, lambda stream: S.stepped(stream, "3650 days"), "steps").select("seq", "was", "status", "legal")


@_query("wn10_streamed_100", f"WITH {W.LOG_SQL} SELECT seq, count(*) OVER w AS n_last, cast(sum(duration) OVER w AS BIGINT) AS sum_last, cast(sum(ok::INT) OVER w AS BIGINT) AS ok_last FROM log WINDOW w AS (PARTITION BY stage ORDER BY seq ROWS 99 PRECEDING)")
def _(spark, d):
    log = W.log(spark, d).select("stage", "seq", "duration", "ok")
    return S.in_batches(log, "seq", 3, S.last_requests, "last").select("seq", "n_last", "sum_last", "ok_last")


def _never(prompt: str) -> str:
    raise RuntimeError("a call that has ended is made again")


@_query("ux01_kept_calls", "SELECT s_suppkey, upper(s_name) AS answer FROM supplier")
def _(spark, d):
    path = folders.new(spark, "calls")
    prompts = W.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("prompt"))
    A.answered_once(prompts.filter("s_suppkey % 2 = 0"), str.upper, path)
    A.answered_once(prompts, str.upper, path)
    folders.deleted_at_exit(spark, path)
    return A.answered_once(prompts, _never, path).select("s_suppkey", "answer")


@_query("snk07_objects_left", "SELECT c_nationkey AS task_id, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_nationkey % 5 <> 1 GROUP BY 1")
def _(spark, d):
    path, rows = folders.new(spark, "objects"), W.table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("task_id"), "c_custkey")
    rows.write.partitionBy("task_id").parquet(path)
    folders.deleted_at_exit(spark, path)
    named = rows.select("task_id", F.concat(F.lit(f"{path}/task_id="), F.col("task_id").cast("string")).alias("image")).distinct()
    sinks.without_objects(named, named.filter("task_id % 5 = 1"), "image")
    return spark.read.schema("c_custkey long, task_id int").parquet(path).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@_query("snk11_delivered", "SELECT listener, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, count(DISTINCT event_id % 4) AS n_batches FROM events, (VALUES ('steady'), ('late')) t(listener) GROUP BY ALL")
def _(spark, d):
    path, events, failures = folders.new(spark, "delivered"), W.table(spark, d, "events").select("event_id", "event_type"), []
    lot = F.pmod("event_id", F.lit(4))

    def steady(batch: DataFrame) -> None:
        batch.write.mode("append").parquet(f"{path}/steady")

    def late(batch: DataFrame) -> None:
        if len(failures) < 2:
            failures.append(1)
            raise ConnectionError("the listener is away")
        batch.write.mode("append").parquet(f"{path}/late")

    delivery = sinks.Delivery(spark, f"{path}/delivery", {"steady": steady, "late": late})
    for number in range(4):
        delivery.take(events.filter(lot == number), number)
    folders.deleted_at_exit(spark, path)
    had = [spark.read.schema(events.schema).parquet(f"{path}/{name}").withColumn("listener", F.lit(name)) for name in delivery.listeners]
    return had[0].unionByName(had[1]).groupBy("listener", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct(lot).alias("n_batches"))

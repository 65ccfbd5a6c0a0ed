"""States that outlive batches and restarts."""

import random

from pyspark.sql import functions as F

from lattica.operators import metrics
from lattica.operators.tasks import STATES, STEPS
from lattica.streaming import states


def _append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


SCHEMA = "task_id string, seq long, status string, ts string"


def _run(spark, tmp_path):
    stream = spark.readStream.schema("task_id string, seq long, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states.drained(states.stepped(stream, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    return {(r.task_id, r.seq): (r.was, r.legal) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_steps_are_refused_across_batches_and_ended_tasks_forgotten(spark, tmp_path):
    _append(spark, str(tmp_path / "in"), [("a", 1, "queued", "2024-01-01 00:00:00"), ("b", 2, "running", "2024-01-01 00:00:01"), (None, 3, "queued", "2024-01-01 00:00:01")], SCHEMA)
    _append(spark, str(tmp_path / "in"), [("a", 5, "completed", "2024-01-01 00:00:03"), ("a", 4, "running", "2024-01-01 00:00:02"), ("b", 6, "queued", "2024-01-01 00:00:03"), ("b", 7, None, "2024-01-01 00:00:03")], SCHEMA)
    assert _run(spark, tmp_path) == {("a", 1): ("pending", True), ("b", 2): ("pending", False), ("a", 4): ("queued", True), ("a", 5): ("running", True), ("b", 6): ("pending", True), ("b", 7): ("queued", False)}
    # After a restart: within the hour an ended task takes no step, later it is a new one; the other still waits.
    _append(spark, str(tmp_path / "in"), [("a", 8, "queued", "2024-01-01 00:30:00")], SCHEMA)
    assert _run(spark, tmp_path)["a", 8] == ("completed", False)
    _append(spark, str(tmp_path / "in"), [("c", 9, "queued", "2024-01-01 02:00:00")], SCHEMA)
    _run(spark, tmp_path)
    _append(spark, str(tmp_path / "in"), [("a", 10, "queued", "2024-01-01 02:00:01"), ("b", 11, "running", "2024-01-01 02:00:02")], SCHEMA)
    got = _run(spark, tmp_path)
    assert got["a", 10] == ("pending", True) and got["b", 11] == ("queued", True)


def _walk(rows):
    now, out = {}, {}
    for task, seq, status in rows:
        was = now.get(task, STATES[0])
        out[task, seq] = (was, status in STEPS.get(was, ()))
        now[task] = status if out[task, seq][1] else was
    return out


def test_any_split_gives_the_same(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(9)}", k, rng.choice(STATES), k) for k in range(300)]
    table = spark.createDataFrame(rows, "task_id string, seq long, status string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000)).drop("at")
    want = _walk([(t, k, s) for t, k, s, _ in rows])
    log = table.select(F.col("task_id").alias("stage"), "seq", (F.col("seq") * 7 % 50).alias("duration"), (F.col("seq") % 3 > 0).alias("ok"))
    whole = {r.seq: (r.n_last, r.sum_last, r.ok_last) for r in metrics.sliding(log, 20).collect()}
    for n in (1, 3):
        got = states.in_batches(table, "seq", n, lambda s: states.stepped(s), "steps")
        assert {(r.task_id, r.seq): (r.was, r.legal) for r in got.collect()} == want
        got = states.in_batches(log, "seq", n, lambda s: states.last_requests(s, 20), "last")
        assert {r.seq: (r.n_last, r.sum_last, r.ok_last) for r in got.collect()} == whole
    assert states.in_batches(log.limit(0), "seq", 2, lambda s: states.last_requests(s, 20), "none").count() == 0

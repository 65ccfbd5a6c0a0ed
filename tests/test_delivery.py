"""Calls that are made once, events that reach each listener, and files that are read once."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import answers
from lattica.sources import sinks, xlsx


def test_a_call_that_has_ended_is_not_made_again(spark, tmp_path):
    """A task is killed after some calls; what comes after makes only the others."""
    log = str(tmp_path / "log")

    def client(prompt, fail=True):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if fail and prompt == "p7":
            raise SystemExit("killed")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    prompts = spark.createDataFrame([(f"p{k}",) for k in range(12)] + [("bad",), ("p1",), (None,)], "prompt string")
    path = str(tmp_path / "kept")
    with pytest.raises(Exception):
        answers.answered_once(prompts, client, path, tasks=1, tries=2, wait=lambda s: None)
    first = open(log).read().split()
    finished = {json.load(open(f))["answer"].lower() for f in glob.glob(f"{path}/calls/*/*.json")}
    assert "p7" in first and finished == set(first) - {"p7", "bad"} and len(finished) > 0
    got = answers.answered_once(prompts, lambda p: client(p, False), path, tasks=3, tries=2, wait=lambda s: None).collect()
    assert sorted((r.prompt or "", r.answer, r.error) for r in got) == sorted([(f"p{k}", f"P{k}", None) for k in (*range(12), 1)] + [("bad", None, "no"), ("", None, None)], key=str)
    calls = open(log).read().split()
    assert all(calls.count(p) == 1 for p in finished) and not glob.glob(f"{path}/calls")
    again = answers.answered_once(prompts.filter("prompt <> 'bad'"), lambda p: 1 / 0, path)
    assert again.filter("answer IS NULL").isEmpty() and answers.kept_answers(spark, path).count() == 12


def test_a_budget_is_shared_by_the_tasks(spark, tmp_path):
    log = str(tmp_path / "waits")

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    answers.answered_once(spark.createDataFrame([(f"p{k}",) for k in range(6)], "prompt string"), str.upper, str(tmp_path / "kept"), tasks=2, per_minute=60, wait=wait, clock=lambda: 0.0)
    waits = [float(x) for x in open(log).read().split()]
    assert len(waits) == 4 and set(waits) == {2.0}


def test_a_listener_that_fails_twice_gets_each_event_once(spark, tmp_path):
    source, seen, fails = str(tmp_path / "in"), {"good": [], "weak": []}, [2]

    def weak(batch):
        if fails[0]:
            fails[0] -= 1
            raise ValueError("away")
        seen["weak"] += sorted(r.id for r in batch.collect())

    listeners = {"weak": weak, "good": lambda batch: seen["good"].extend(sorted(r.id for r in batch.collect()))}
    checkpoint = str(tmp_path / "ck")
    delivery = sinks.Delivery(spark, f"{checkpoint}-delivery", listeners)
    for k, left in ((0, [0, 1, 2]), (1, [0, 1, 2, 10, 11, 12]), (2, [])):
        spark.range(10 * k, 10 * k + 3).coalesce(1).write.mode("append").parquet(source)
        sinks.fan_out(spark.readStream.schema("id long").parquet(source), listeners, checkpoint).awaitTermination()
        waits = delivery.undelivered("weak")
        assert ([] if waits is None else sorted(r.id for r in waits.collect())) == left and delivery.undelivered("good") is None
    assert seen["weak"] == seen["good"] == [0, 1, 2, 10, 11, 12, 20, 21, 22] and not delivery._numbers()
    delivery.take(spark.range(3), 1)
    assert len(seen["good"]) == 9 and delivery.redeliver() == {} and delivery.reached("weak") == 2


def test_uploads_are_read_once_over_restarts(spark, tmp_path):
    root, out, checkpoint = (str(tmp_path / x) for x in ("up", "out", "ck"))
    (tmp_path / "up").mkdir()
    for k in range(3):
        for n in range(2):
            (tmp_path / "up" / f"f{k}{n}.xlsx").write_bytes(xlsx.book(iter([[k, "x"], [n, "y"]])))
        (tmp_path / "up" / "other.txt").write_text("no sheet")
        xlsx.arriving(spark, root, files_at_once=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == 4 * (k + 1) and rows.select(F.countDistinct("path", "row_idx")).first()[0] == 4 * (k + 1)


def test_first_items_are_chosen_before_they_are_gathered(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("k"), "id", F.create_map(F.lit("code"), F.col("id").cast("string")).alias("item"))
    got = {r.k: [x["code"] for x in r["items"]] for r in answers.first_items(rows, "k", ["id"], "item", 4).collect()}
    assert got == {k: [str(k + 3 * j) for j in range(4)] for k in range(3)}

"""Versions appear whole or not at all."""

import glob

import pytest
from pyspark.sql import functions as F

from lattica.sources import committed


def _rows(spark, rows):
    return spark.createDataFrame(rows, "task_id long, code string, name string").repartition(3)


def _got(spark, path, version=None):
    return sorted((r.task_id or 0, r.code, r.name, r.version, r.is_current) for r in committed.read(spark, path, version).collect())


def test_insert_replace_and_change(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write(_rows(spark, [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (None, "n", "x")]), path)
    committed.write(_rows(spark, [(1, "a", "y"), (3, "c", "y"), (None, "n", "y")]), path)
    assert _got(spark, path) == [(0, "n", "x", 1, False), (0, "n", "y", 2, True), (1, "a", "x", 1, False), (1, "a", "y", 2, True), (1, "b", "x", 1, False), (2, "a", "x", 1, True), (3, "c", "y", 2, True)]
    assert all(x[4] for x in _got(spark, path, 1)) and len(_got(spark, path, 1)) == 4
    committed.write(_rows(spark, [(1, "z", "r")]), path, "replace")
    assert [x for x in _got(spark, path) if x[0] == 1] == [(1, "z", "r", 3, True)]
    committed.changed(spark, path, spark.createDataFrame([(2, "a", "new"), (3, "c", None)], "task_id long, code string, name string"), ["name"], ["task_id", "code"])
    assert [x for x in _got(spark, path) if x[0] in (2, 3)] == [(2, "a", "new", 4, True), (3, "c", "y", 4, True)]
    assert (0, "n", "x", 1, False) in _got(spark, path)
    assert [(r.version, r.op, r.has_current) for r in committed.history(spark, path).collect()] == [(1, "insert", False), (2, "insert", True), (3, "replace", True), (4, "amend", True)]
    committed.write(_rows(spark, [(9, "q", "q")]).limit(0), path)
    assert committed.latest(path) == 5 and len(_got(spark, path)) == len(_got(spark, path, 4))


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write(_rows(spark, [(1, "a", "x")]), path)
    before, files = _got(spark, path), len(glob.glob(f"{path}/data/*"))
    bad = spark.range(0, 4000, 1, 4).select(F.lit(1).cast("long").alias("task_id"), F.col("id").cast("string").alias("code"), F.when(F.col("id") == 3999, F.raise_error(F.lit("task lost"))).otherwise(F.lit("new")).cast("string").alias("name"))
    with pytest.raises(Exception, match="task lost"):
        committed.write(bad, path)
    assert _got(spark, path) == before and committed.latest(path) == 1
    committed.write(bad.filter("code <> '3999'"), path)
    got = _got(spark, path)
    assert len(got) == 4000 and sum(x[4] for x in got) == 3999 and (1, "a", "x", 1, False) in got and files == 1


def test_two_writers_and_wrong_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write(_rows(spark, [(1, "a", "x")]), path)
    with pytest.raises(Exception, match="came first"):
        committed.write(_rows(spark, [(1, "a", "late")]), path, "replace", expected=0)
    assert len(glob.glob(f"{path}/data/*")) == 1 and committed.latest(path) == 1
    assert not committed._put(path, {"version": 1}) and committed._put(path, {**committed.manifests(path)[0], "version": 2, "files": []})
    for rows, how in ((spark.range(1).withColumnRenamed("id", "task_id"), {}), (_rows(spark, [(1, "a", "x")]), {"op": "other"}), (_rows(spark, [(1, "a", "x")]), {"key": "none"})):
        with pytest.raises(Exception):
            committed.write(rows, path, **how)
    (tmp_path / "t" / "log" / "000000000009.json").write_text('{"version": 9')
    assert committed.latest(path) == 2 and len(_got(spark, path)) == 1
    with pytest.raises(ValueError):
        committed.read(spark, str(tmp_path / "none"))

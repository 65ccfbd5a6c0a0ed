"""Ordered folds and frames, tasks, trees, graphs, registries and queues on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import registry
from lattica.functions import text
from lattica.operators import answers, graphs, hierarchy, metrics, order, reconcile, sheets, tasks, versions
from lattica.sources import objects, sinks, xlsx
from lattica.streaming import tasks as streams


def _rows(spark, n=400):
    rng = random.Random(4)
    rows = [("hot" if k % 3 else f"k{k % 7}", k * 37 % 1009 * 5, rng.randrange(20)) for k in range(n)]
    rows = [(None if k == "k5" else k, at, took) for k, at, took in rows]
    return rows, spark.createDataFrame(rows, "kind string, at long, took long")


def _by_kind(rows):
    out = {}
    for k, at, took in sorted(rows, key=lambda r: (r[0] or "", *r[1:])):
        out.setdefault(k, []).append((at, took))
    return out


def test_places_do_not_depend_on_ranges(spark):
    rows, df = _rows(spark)
    want = {(k, at): n for k, own in _by_kind(rows).items() for n, (at, _) in enumerate(own, 1)}
    for width in (7, 100, 1 << 16):
        assert {(r.kind, r.at): r.n for r in order.numbered(df, ["kind"], F.col("at"), width=width).collect()} == want


def test_frames_see_their_neighbours(spark):
    rows, df = _rows(spark)
    placed = order.numbered(df, ["kind"], F.col("at"), width=64)
    columns = lambda w: {"s": F.sum("took").over(w.rowsBetween(-3, 0)), "after": F.lead("took", 2).over(w)}
    got = {(r.kind, r.at): (r.s, r.after) for r in order.over_frame(placed, ["kind"], columns, before=3, after=2, size=5).collect()}
    for k, own in _by_kind(rows).items():
        for n, (at, _) in enumerate(own):
            assert got[k, at] == (sum(t for _, t in own[max(0, n - 3) : n + 1]), own[n + 2][1] if n + 2 < len(own) else None)
    assert len(got) == len(rows)


def test_peak_over_ranges(spark):
    rows, df = _rows(spark)
    marks = df.select("kind", "at", F.lit(1).alias("d")).unionByName(df.select("kind", (F.col("at") + F.col("took")).alias("at"), F.lit(-1).alias("d")))
    got = {r.kind: r.peak for r in order.peak(marks, ["kind"], F.col("at"), F.col("d"), width=16).collect()}
    for k, own in _by_kind(rows).items():
        assert got[k] == max(sum(a <= t < a + took for a, took in own) for t, _ in own)


def test_permits_windows_and_bounded_queue(spark):
    rows, df = _rows(spark)
    spans = df.select("kind", F.col("at").alias("begin"), (F.col("at") + F.col("took") + 1).alias("end"))
    granted = {(r.kind, r.begin): r.granted for r in tasks.granted(spans, {"hot": 2}).collect()}
    windows = {(r.kind, r.at): (r.window_start, r.n_in_window) for r in tasks.arrival_windows(df, 50).collect()}
    dropped = {(r.kind, r.at): r.dropped for r in tasks.bounded_queue(df, 1).collect()}
    for k, own in _by_kind(rows).items():
        held, start, n, ends = [], None, 0, []
        for at, took in own:
            held = [e for e in held if e > at]
            free = len(held) < (2 if k == "hot" else 1)
            held += [at + took + 1] if free else []
            assert granted[k, at] == free
            start, n = (at, 1) if start is None or at - start >= 50 else (start, n + 1)
            assert windows[k, at] == (start, n)
            ends = [e for e in ends if e > at]
            assert dropped[k, at] == (len(ends) > 1)
            ends += [] if len(ends) > 1 else [max(at, ends[-1] if ends else at) + took]
    assert tasks.granted(spans.limit(0), {}).count() == 0


def test_arrival_windows_of_any_range(spark):
    """A kind's windows are those of a walk, however its seconds are cut; null times are in none."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", None, "rare"]), at) for at in (rng.randrange(-500, 4000) for _ in range(900))] + [("hot", 50_000 + k // 40) for k in range(300)] + [("hot", None), (None, None)]
    want, state = [], {}
    for kind, at in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        start, n = state.get(kind, (None, 0))
        state[kind] = (at, 1) if start is None or at - start >= 30 else (start, n + 1)
        want.append((kind, at, *state[kind]))
    table = spark.createDataFrame(rows, "kind string, at long").repartition(5)
    for width in (1, 7, 1024):
        got = [tuple(r) for r in tasks.arrival_windows(table, 30, width).collect()]
        assert sorted(map(str, (g for g in got if g[1] is not None))) == sorted(map(str, want))
        assert sorted(map(str, (g for g in got if g[1] is None))) == ["('hot', None, None, None)", "(None, None, None, None)"]
    assert tasks.arrival_windows(table.limit(0), 30).count() == 0


def test_states_and_events(spark):
    rows = spark.createDataFrame([(1, 0, "queued", None), (1, 1, "running", None), (1, 2, "failed", "no"), (2, 0, "running", None), (2, 1, "completed", None)], "task_id int, seq int, status string, error string")
    assert {(r.task_id, r.seq): r.legal for r in tasks.walked(rows).collect()} == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): True}
    assert {(r.task_id, r.event): (r.progress, r.message) for r in tasks.events(rows).collect()} == {(1, "started"): (0.0, None), (1, "failed"): (None, "no"), (2, "started"): (0.0, None), (2, "completed"): (100.0, None)}
    page = tasks.page_of(rows, ["task_id", "seq"], 2, 1).collect()
    assert [(r.task_id, r.seq, r.total) for r in page] == [(1, 1, 5), (1, 2, 5)]


def _tree(spark, codes_):
    return hierarchy.built(spark.createDataFrame([(k, c, f"n{k}") for k, c in enumerate(codes_)], "seq long, code string, name string"))


def test_depth_below_orphans(spark):
    got = {r.code: (r.root_code, r.depth) for r in hierarchy.with_depth(_tree(spark, ["1", "1-01", "2-01", "2-01-03", "3-01-02-04", "1-01-05"])).collect()}
    assert got == {"1": ("1", 1), "1-01": ("1", 2), "1-01-05": ("1", 3), "2-01": ("2-01", 1), "2-01-03": ("2-01", 2), "3-01-02-04": ("3-01-02-04", 1)}


def test_pruned_and_merged(spark):
    tree = _tree(spark, ["1", "1-01", "1-01-01", "1-01-02", "1-02", "2-01", "2-01-01"])
    left = lambda **options: {r.code for r in hierarchy.pruned(tree, **options).collect()}
    assert left(max_depth=2) == {"1", "1-01", "1-02", "2-01", "2-01-01"}
    assert left(orphans=True) == {"1", "1-01", "1-01-01", "1-01-02", "1-02"}
    assert left(min_children=2) == {"1", "1-01", "1-01-01", "1-01-02", "1-02"}
    assert left(keep=F.col("code") != "1-01", empty=True) == {"1", "1-02", "2-01", "2-01-01"}
    assert left(keep_levels=(1,)) == {"1", "2-01"}
    a, b = (spark.createDataFrame(x, "code string, name string") for x in ([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d")]))
    got = lambda **options: {r.code: r.name for r in hierarchy.merged(a, b, **options).collect()}
    assert got() == got(how="first") == {"1": "a", "2": "b", "3": "d"} and got(conflict="overwrite") == got(how="last") == {"1": "a", "2": "c", "3": "d"}
    assert got(how="intersection") == {"2": "b"} and got(how="intersection", conflict="overwrite") == {"2": "c"}
    assert {r.code for r in hierarchy.merged(a, a, conflict="error").collect()} == {"1", "2"}
    with pytest.raises(Exception, match="rows differ for code 2"):
        hierarchy.merged(a, b, conflict="error").collect()


def test_ties_are_settled_by_the_other_columns(spark):
    rows = spark.createDataFrame([(0, "1", "b"), (0, "1", "a"), (None, "2", None)], "seq long, code string, name string")
    assert {r.code: r.name for r in hierarchy.first_wins(rows).collect()} == {"1": "a", "2": None} and {r.code: r.name for r in hierarchy.last_wins(rows).collect()} == {"1": "b", "2": None}
    events = spark.createDataFrame([(1, 5, "queued"), (1, 5, "running")], "task_id int, seq int, status string")
    assert metrics.latest_state(events).first().status == "running"


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 1)], "src long, dst long")
    assert [(r.step, r.node) for r in graphs.path(edges, 1, 4).orderBy("step").collect()] == [(0, 1), (1, 5), (2, 4)]
    assert graphs.path(edges, 1, 9).count() == 0 and [r.node for r in graphs.path(edges, 2, 2).collect()] == [2]
    with pytest.raises(RuntimeError):
        graphs.path(spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), 0, 8, rounds=3)


def test_cells_of_major_classes(spark):
    rows = spark.createDataFrame([("第三大类\n3 ( GBM 300 ) 生产 人员",), ("第三大类 9 x",), ("第一大类 1",), ("第八大类 8 军人",)], "t string")
    got = [r.p and tuple(r.p) for r in rows.select(text.major_class(F.col("t")).alias("p")).collect()]
    assert got == [("3", "300", "生产人员"), None, None, ("8", "", "军人")]
    assert [r[0] for r in spark.createDataFrame([("10000",), ("",), ("x7 8",)], "t string").select(text.gbm_number(F.col("t"))).collect()] == [10000, 0, 78]
    cells = spark.createDataFrame([(0, ["第一大类 1 (GBM 10000) 负责人", "1-01 (GBM 10100) 机 关", "1-01-01 代表 1-01-02 委员", "", "1-01-01-01\n1-01-01-02", "甲\n乙"]), (1, ["", "", "", "", "续表", "x"])], "row_idx int, cells array<string>")
    skeleton, packed, counts = sheets.hybrid(cells)
    assert [(r.code, r.gbm, r.name) for r in skeleton.orderBy("col", "pos").collect()] == [("1", 10000, "负责人"), ("1-01", 10100, "机关"), ("1-01-01", 0, "代表"), ("1-01-02", 0, "委员")]
    assert [(r.parent_code, r.parent_name, list(r.codes), list(r.names)) for r in packed.collect()] == [("1-01-01", "代表", ["1-01-01-01", "1-01-01-02"], ["甲", "乙"])]
    assert {r.what: r.n for r in counts.collect()} == {"rows": 2, "skeleton": 4, "tasks": 1} and sheets.row_pairs(cells).count() == 2


def test_choices_by_place(spark):
    choices = spark.createDataFrame([(0, "1", "a", 0.9, "", "x"), (1, "2", "b", 0.8, "1", "y"), (2, "3", "c", 0.7, "1", "y"), (3, "4", "d", 0.6, "1", "y")], "pos int, code string, rule_name string, rule_confidence double, parent_code string, level string")
    replies = spark.createDataFrame([(0, '{"name": "z", "selected_from": "pdf"}'), (1, "no json"), (2, '{"name": 5}')], "pos int, answer string")
    assert [(r.name, r.selected_from) for r in reconcile.transformed(choices, replies).orderBy("pos").collect()] == [("z", "pdf"), ("b", None), ("c", None), ("d", None)]


def test_filling_and_stamping(spark):
    rows = spark.createDataFrame([("1", ""), ("2", "kept"), ("3", None)], "code string, name string")
    better = spark.createDataFrame([("1", "new"), ("2", "other"), ("3", "")], "code string, name string")
    assert {r.code: r.name for r in versions.filled(rows, better, "name").collect()} == {"1": "new", "2": "kept", "3": None}
    assert [(r.batch_id, r.is_current) for r in versions.stamped(rows, 4, 5).collect()] == [(4, True)] * 3


def test_calls_are_tried_again(spark, tmp_path):
    def client(prompt, folder=str(tmp_path)):
        import os

        own = os.path.join(folder, prompt)
        with open(own, "a") as f:
            f.write("x")
        if os.path.getsize(own) < int(prompt):
            raise ValueError("busy")
        return "done"

    got = {r.prompt: (r.answer, r.error) for r in answers.answered(spark.createDataFrame([("1",), ("3",), ("4",), (None,)], "prompt string"), client, wait=lambda s: None).collect()}
    assert got == {"1": ("done", None), "3": ("done", None), "4": (None, "busy"), None: (None, None)}


def test_registries_and_kept_tables(spark):
    assert registry.PARSERS.names() == ["details", "hybrid", "records"] and registry.PROVIDERS.create("echo")("x") == "x"
    with pytest.raises(KeyError):
        registry.BUILDERS.create("none")
    seen = []
    parser = registry.CachedParser(lambda rows: seen.append(1) or rows)
    assert parser("a", spark.range(3)).count() == parser("a", spark.range(9)).count() == 3 and len(seen) == 1
    parser.give_up()
    assert parser("a", spark.range(9)).count() == 9
    rows = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    assert [r.violations for r in registry.violations(rows, {"small": F.col("n") < 2, "text": F.col("s") != ""}).orderBy("n").collect()] == [[], ["small", "text"]]
    assert [r.s for r in registry.transformed(rows, [("s", F.col("s").isNull(), F.lit("none"))]).orderBy("n").collect()] == ["x", "none"]
    with pytest.raises(NotImplementedError):
        xlsx.parse(None)


def test_objects_are_put_signed_and_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.bin"
    objects.put(spark, path, b"abc")
    objects.put(spark, path, b"abcd")
    row = objects.stat(spark, str(tmp_path)).first()
    assert (row.name, row.length, row.type) == ("b.bin", 4, "bin") and objects.delete(spark, path) and not objects.delete(spark, path)
    link = objects.presigned("s/a", b"key", 100)
    assert objects.is_signed(link, b"key", 99) and not objects.is_signed(link, b"key", 101) and not objects.is_signed(link.replace("s/a", "s/b"), b"key", 99)
    rows = spark.createDataFrame([(1, f"file://{tmp_path}/c"), (2, None)], "task_id int, image string")
    objects.put(spark, f"file://{tmp_path}/c", b"x")
    assert [r.task_id for r in sinks.without_objects(rows, rows.filter("task_id = 1").select("task_id"), "image").collect()] == [2] and not (tmp_path / "c").exists()


def test_many_objects_are_deleted_in_lots(spark, tmp_path):
    paths = [f"file://{tmp_path}/o{k}" for k in range(50)]
    for path in paths:
        objects.put(spark, path, b"x")
    assert objects.delete_all(spark, iter([*paths, *paths[:5]]), lanes=4, lot=7) == 50 and not list(tmp_path.glob("o*"))
    assert objects.delete_all(spark, []) == 0
    objects.put(spark, paths[1], b"x")
    with pytest.raises(Exception, match="nowhere"):
        objects.delete_all(spark, ["nowhere://a/b", paths[1]])
    assert not (tmp_path / "o1").exists()


def test_queue_and_listeners(spark, tmp_path):
    rows = spark.createDataFrame([(1, "rule", "2024-01-01 00:00:00"), (2, "other", "2024-01-01 00:00:01"), (3, "rule", "2024-01-01 00:00:02")], "task_id int, kind string, created string").withColumn("created", F.col("created").cast("timestamp"))
    queued = tasks.enqueued(rows)
    assert {r.task_id: r.queue for r in queued.collect()} == {1: "queue:rule", 2: "queue:default", 3: "queue:rule"}
    assert sorted(r.task_id for r in tasks.alive(queued, F.lit("2024-01-02 00:00:00.5").cast("timestamp")).collect()) == [2, 3]
    assert sorted(r.task_id for r in tasks.dequeued(queued).collect()) == [1, 2]
    sinks.enqueued(queued.drop("expires"), str(tmp_path / "q"))
    stream = streams.dequeued(spark, str(tmp_path / "q"), queued.drop("expires").schema, "queue:rule")
    seen = []

    def broken(batch):
        raise ValueError("no")

    sinks.fan_out(stream, [broken, lambda batch: seen.extend(r.task_id for r in batch.collect())], str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [1, 3]

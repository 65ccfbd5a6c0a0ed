"""Operators on the literal fixtures of FIXTURES.md."""

from pyspark.sql import functions as F

from lattica.functions import codes, text
from lattica.operators import blocks, hierarchy, metrics, reconcile, sheets, versions


def _codes(spark, values):
    return spark.createDataFrame([(k, c, f"n{k}") for k, c in enumerate(values)], "seq long, code string, name string")


COMPLEX = ["1", "1-01", "1-01-01", "1-01-01-01", "1-01-01-02", "1-01-02", "1-02", "2", "2-01", "2-01-01"]


def test_level_names(spark):
    rows = spark.createDataFrame([("1",), ("1-01",), ("1-01-01",), ("1-01-01-01",), ("1-1-1-1-1",), ("",)], "code string")
    got = [tuple(r) for r in rows.select(codes.level_of(F.col("code")), codes.level_of_parts(F.col("code")), codes.level_int(F.col("code")), codes.parent_code(F.col("code"))).collect()]
    assert [g[0] for g in got[:5]] == ["大类", "中类", "小类", "细类", "未知级别"]
    assert got[4][1] == "细类" and [g[2] for g in got] == [0, 1, 2, 3, 4, -1] and got[3][3] == "1-01-01" and got[0][3] == ""


def test_code_validity(spark):
    good, bad = ["1", "1-01", "1-01-01", "1-01-01-01"], ["", "-1", "1-", "1--01", "1-01a", "1-01!", "a-01", "1-01\n"]
    rows = spark.createDataFrame([(c,) for c in good + bad], "code string")
    assert [r[0] for r in rows.select(codes.is_valid_code(F.col("code"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_build_complex(spark):
    tree = hierarchy.built(_codes(spark, COMPLEX))
    s = hierarchy.statistics(tree).first()
    assert (s.n_nodes, s.max_depth, s.n_roots, s.n_level_0, s.n_level_1, s.n_level_2, s.n_level_3) == (10, 4, 2, 2, 3, 3, 2)
    assert [r.code for r in hierarchy.preorder(tree).orderBy("pos").collect()] == sorted(COMPLEX)
    assert {r.code: r.n_children for r in hierarchy.children_count(tree).collect()}["1"] == 2
    assert {r.code: r.n_descendants for r in hierarchy.descendants_count(tree).collect()} == {"1": 6, "1-01": 4, "1-01-01": 2, "2": 2, "2-01": 1}
    assert {r.code for r in hierarchy.leaves(tree).collect()} == {"1-01-01-01", "1-01-01-02", "1-01-02", "1-02", "2-01-01"}


def test_orphans(spark):
    rows = _codes(spark, ["1", "1-01-01", "2-01"])
    assert hierarchy.built(rows).filter("tree_parent = ''").count() == 3
    assert [r.code for r in hierarchy.built(rows, "drop").collect()] == ["1"]
    assert {r.code for r in hierarchy.missing_parents(rows).collect()} == {"1-01", "2"}
    assert {r.code for r in hierarchy.roots(rows).collect()} == {"1", "1-01-01", "2-01"}


def test_duplicates_first_and_last(spark):
    rows = spark.createDataFrame([(0, "1", "a"), (1, "1", "b"), (2, "1-01", "c")], "seq long, code string, name string")
    assert {r.code: r.name for r in hierarchy.first_wins(rows).collect()} == {"1": "a", "1-01": "c"}
    assert {r.code: r.name for r in hierarchy.last_wins(rows).collect()} == {"1": "b", "1-01": "c"}


def test_validation_errors(spark):
    rows = spark.createDataFrame([("", "x", "大类"), ("1", "", "大类"), ("1", "x", ""), ("1", "x", "other"), ("1-ab!", "x", "大类")], "code string, name string, level string")
    assert hierarchy.validated(rows).count() == 7


def test_parse_cell(spark):
    cases = [("1 (GBM 10000) X", ("1", "10000", "X")), ("1-01 X", ("1-01", "", "X")), ("P 1-02-03 (GBM 10203) S", ("1-02-03", "10203", "P S")), ("P 1-02-03 (GBM 10203) S", ("1-02-03", "10203", "P S")), ("", None), ("none", None)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = [r.p and tuple(r.p) for r in rows.select(text.parsed_cell(F.col("t")).alias("p")).collect()]
    assert got == [w for _, w in cases]


def test_record_texts(spark):
    cases = [("1 (GBM 10000) A", 1), ("1 (GBM 10000) A 1-01 B", 2), ("nothing", 0), ("", 0), ("1 (GBM 10000) A 1-01 B 有效记录2", 3)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    assert [r[0] for r in rows.select(F.size(text.record_texts(F.col("t")))).collect()] == [n for _, n in cases]


def test_normalize_name(spark):
    rows = spark.createDataFrame([("　技 术\t员\r\n x  y z ",)], "t string")
    once = rows.select(text.normalized_name(F.col("t")).alias("t"))
    assert once.first()[0] == "技术员 x y z" and once.select(text.normalized_name(F.col("t"))).first()[0] == once.first()[0]


def test_sheets(spark):
    e, f = "1-01-01-01\n1-01-01-02", "a\nb"
    data = [(0, ["1 (GBM 1) x", "", "", "", e, f]), (1, ["", "", "", "", e + "\n1-01-01-03", f]), (2, ["", "", "", "", "续表", "续表"]), (3, []), (4, ["大类", "x", "", "", e, f]), (5, ["a", "续 表"]), (6, ["", "", "", "", "1-01\n1-01-01-09", "a\nb"])]
    rows = spark.createDataFrame(data, "row_idx int, cells array<string>")
    assert [r[0] for r in rows.select(sheets.is_junk(F.col("cells"))).collect()] == [False, False, True, True, True, True, False]
    got = [(r.row_idx, r.pos, r.code, r.name) for r in sheets.detail_records(rows).orderBy("row_idx", "pos").collect()]
    assert got == [(0, 0, "1-01-01-01", "a"), (0, 1, "1-01-01-02", "b"), (1, 0, "1-01-01-01", "a"), (1, 1, "1-01-01-02", "b"), (6, 0, "1-01-01-09", "a")]
    smalls = spark.createDataFrame([("1-01-01",)], "code string")
    assert sheets.detail_records_of(rows, smalls).filter("row_idx = 1").count() == 2


def test_blocks(spark):
    span = lambda t, x, y, size=12.0, flags=0: {"text": t, "bbox": [x, y, x + 50, y + 10], "font": "f", "size": size, "flags": flags}
    pages = spark.createDataFrame(
        [("t", 1, [{"lines": [{"spans": [span("1-01-01-01", 10.0, 0.0, 24.0, 16), span(" ", 0.0, 0.0), span("技术员", 60.0, 1.0)]}]}, {"lines": [{"spans": [span("2-02-02-02", 30.0, 40.0), span("123", 60.0, 41.0), span("工人", 60.0, 55.0)]}]}])],
        "task_id string, page_num int, blocks array<struct<lines: array<struct<spans: array<struct<text: string, bbox: array<double>, font: string, size: double, flags: int>>>>>>",
    )
    rows = blocks.derived(blocks.from_pages(pages))
    assert [r.block_num for r in rows.orderBy("block_num").collect()] == [0, 1, 2, 3, 4]
    got = {r.occupation_code: (r.occupation_name, r.confidence) for r in blocks.matched(rows).collect()}
    assert got == {"1-01-01-01": ("技术员", 0.9), "2-02-02-02": ("工人", 0.7)}
    levels = {r.text: r.hierarchy_level for r in blocks.with_levels(rows).collect()}
    assert levels["1-01-01-01"] == 1 and levels["技术员"] == 4
    fold = spark.createDataFrame([([10.0, 20.0, 26.0, 45.0, 61.0, 62.0, 100.0, 200.0],)], "x array<double>")
    assert fold.select(blocks.indent_levels(F.col("x"))).first()[0] == [10.0, 26.0, 45.0, 61.0]


def test_versions(spark):
    rows = spark.createDataFrame([("t", "1", 1, 1, False), ("t", "2", 1, 1, False), ("t", "1", 2, 2, True)], "task_id string, code string, batch_id int, batch_ts int, is_current boolean")
    assert versions.latest_complete(rows, 1).first().batch_id == 1
    assert {r.code for r in versions.resolved(rows, 1).collect()} == {"1", "2"} and versions.resolved(rows, 5).count() == 1
    after = versions.inserted(rows, spark.createDataFrame([("t", "9", 3, 3, False)], rows.schema))
    assert [r.code for r in after.filter("is_current").collect()] == ["9"] and after.count() == 4


def test_reconcile_accounts_for_all(spark):
    rules = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "code string, name string")
    found = spark.createDataFrame([(0, "1", "x"), (1, "1", "a"), (2, "9", "b"), (3, "8", "")], "seq int, code string, name string")
    assert {r.code: r.kind for r in reconcile.kind(reconcile.fused(rules, found)).collect()} == {"1": "same", "2": "rule_only", "3": "rule_only", "9": "pdf_only"}
    assert {r.code: r.matched_by for r in reconcile.matched(rules, found).collect()} == {"1": "code", "2": "name", "3": "none"}


def test_stage_metrics(spark):
    rows = spark.createDataFrame([(0, "pdf", 100, True), (1, "pdf", 200, True), (2, "pdf", 150, True), (3, "llm", 500, True), (4, "llm", 300, False)], "seq long, stage string, duration long, ok boolean")
    got = {r.stage: (r.n, r.min_duration, r.max_duration, r.sum_duration / r.n, r.n_errors) for r in metrics.stage_metrics(rows).collect()}
    assert got == {"pdf": (3, 100, 200, 150, 0), "llm": (2, 300, 500, 400, 1)}
    last = metrics.sliding(rows, 2).filter("seq = 2").first()
    assert (last.n_last, last.sum_last) == (2, 350)


def test_json_part(spark):
    rows = spark.createDataFrame([('x [{"a":1}] y',), ('{"a": 2} z',), ("none",)], "t string")
    assert [r[0] for r in rows.select(text.json_part(F.col("t"))).collect()] == ['[{"a":1}]', '{"a": 2}', ""]

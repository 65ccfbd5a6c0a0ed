"""Answers, validation, graphs, sources, sinks and streams on small tables."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import answers, graphs, validation
from lattica.sources import objects, sinks, xlsx
from lattica.streaming import tasks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {NS}><sheetData/></worksheet>")


def test_xlsx_rows_are_ragged(spark, tmp_path):
    _book(tmp_path / "a.xlsx")
    xlsx.register(spark)
    rows = spark.read.format("xlsx").load(str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.row_idx, list(r.cells)) for r in rows] == [(0, ["one", "", "two"]), (2, ["", "x", "7"])]
    assert spark.read.format("xlsx").option("sheet", "B").load(str(tmp_path / "a.xlsx")).count() == 0
    assert sorted((r.row_idx, list(r.cells)) for r in xlsx.sheet_rows(spark, str(tmp_path), lot=1).collect()) == [(0, ["one", "", "two"]), (2, ["", "x", "7"])]
    with pytest.raises(ValueError):
        list(xlsx.rows(str(tmp_path / "a.xlsx"), "C"))


@pytest.mark.parametrize(
    ("answer", "codes"),
    [
        ('{"items": [{"code": "1", "name": "a"}]}', ["1"]), ('[{"code": "1"}, {"code": "2"}]', ["1", "2"]), ('say [{"code": "1"}] so', ["1"]),
        ('[\n{"code": "1"},\n{"code": "2"},\n{"code', ["1", "2"]), ("none", []), ("", []), (None, []), ('{"code": "9"}', ["9"]), ("[]", []),
    ],
)
def test_answers(spark, answer, codes):
    row = spark.createDataFrame([(answer,)], "a string").select(F.transform(answers.items(F.col("a")), lambda x: x["code"]).alias("c")).first()
    assert row.c == codes


def test_failed_calls_are_rows(spark):
    def client(p):
        if p == "bad":
            raise ValueError("no")
        return p * 2

    got = {r.prompt: (r.answer, r.error) for r in answers.answered(spark.createDataFrame([("a",), ("bad",), ("a",)], "prompt string"), client, wait=lambda s: None).collect()}
    assert got == {"a": ("aa", None), "bad": (None, "no")}


def test_truncated_keeps_a_prefix(spark):
    rows = spark.createDataFrame([([("a",), ("b" * 50,), ("c",)],), ([],)], "x array<struct<code:string>>")
    assert [len(r.t) for r in rows.select(answers.truncated(F.col("x"), 40).alias("t")).collect()] == [1, 0]


def test_strict_verdict(spark):
    pages = spark.createDataFrame([(1, 10, 20, "x"), (1, 10, 20, None), (2, 10, 20, " ")], "doc int, width int, height int, text string")
    got = {r.doc: (r.is_valid, r.errors, r.warnings) for r in validation.verdict(validation.page_facts(pages), strict=True).collect()}
    assert got == {1: (True, [], []), 2: (False, ["text is required"], ["no text"])}
    assert validation.page_facts(pages.limit(0)).count() == 0
    read = spark.createDataFrame([(1, None), (1, "bad"), (2, None)], "doc int, error string")
    assert {r.doc: (r.is_complete, r.n_failed) for r in validation.integrity(read).collect()} == {1: (False, 1), 2: (True, 0)}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    edges = nodes.filter("node % 100 <> 99").select((F.col("node") + 1).alias("src"), F.col("node").alias("dst"))
    assert {r.component for r in graphs.components(nodes, edges).collect()} == {0, 100, 200}
    with pytest.raises(RuntimeError):
        graphs.components(nodes, edges, rounds=1)


def test_replacement_leaves_other_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.appended(spark.createDataFrame([(1, "a"), (2, "b")], "task_id int, code string"), path, ["task_id"])
    sinks.replaced_by_task(spark.createDataFrame([(2, "c"), (2, "d")], "code_id int, code string").withColumnRenamed("code_id", "task_id"), path)
    assert sorted((r.task_id, r.code) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_objects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"abc")
    assert [(r.path.rpartition("/")[2], r.length) for r in objects.listed(spark, str(tmp_path)).collect()] == [("a.bin", 3)]
    assert objects.content(spark, str(tmp_path / "sub" / "a.bin")).first().md5 == "900150983cd24fb0d6963f7d28e17f72"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "queued", "2024-01-01 00:00:00"), (1, "running", "2024-01-01 00:00:30"), (2, "queued", "2024-01-01 00:02:00")], "task_id int, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def ran(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted((r.task_id, r.status) for r in ran(tasks.latest_states(stream()), "complete", "latest")) == [(1, "running"), (2, "queued")]
    assert sorted(r.task_id for r in ran(tasks.first_within(stream()), "append", "first")) == [1, 2]
    assert sorted((r.status, r.n) for r in ran(tasks.window_counts(stream(), "status"), "complete", "counts")) == [("queued", 1), ("queued", 1), ("running", 1)]
    old = tasks.kept(spark.createDataFrame([(1, "failed", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00")], "task_id int, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-01 02:00:00")
    assert [r.task_id for r in old.collect()] == [2]

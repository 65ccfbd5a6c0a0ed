"""Sheets in pieces: every cut gives the rows of the whole."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.sources import xlsx


def _cells(seed=1, n=300):
    rng = random.Random(seed)
    return [[rng.choice([None, "a <b> & \"c\"", "é 技术", k, 2.5, ""]) for _ in range(rng.randrange(7))] for k in range(n)]


def _want(rows):
    out = []
    for k, cells in enumerate(rows):
        while cells and cells[-1] is None:
            cells = cells[:-1]
        out.append((k, ["" if x is None else str(x) for x in cells]))
    return out


def _save(path, rows):
    path.write_bytes(xlsx.book(iter(rows)))


def test_pieces_of_any_size():
    rows = _cells()
    body = xlsx.book(iter(rows))
    assert list(xlsx.rows(io.BytesIO(body))) == _want(rows)
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        xml = z.read("xl/worksheets/sheet1.xml")
    whole = [r for p in xlsx.pieces(io.BytesIO(xml), 1 << 20) for r in xlsx.parsed(p)]
    for size in (1, 37, 500, 4000):
        assert [r for p in xlsx.pieces(io.BytesIO(xml), size) for r in xlsx.parsed(p)] == whole
        for step in (700, 5000):
            assert [r for a in range(0, len(xml), step) for p in xlsx.pieces(io.BytesIO(xml), size, a, a + step) for r in xlsx.parsed(p)] == whole
    odd = xml.replace(b"<row", b"<x:row").replace(b"</row", b"</x:row").replace(b"<c ", b"<x:c ").replace(b"</c>", b"</x:c>").replace(b"<v>", b"<x:v>").replace(b"</v>", b"</x:v>")
    odd = odd.replace(b"<worksheet xmlns", b"<x:worksheet xmlns:x").replace(b"</worksheet", b"</x:worksheet").replace(b"<sheetData", b"<x:sheetData").replace(b"</sheetData", b"</x:sheetData")
    assert [r for p in xlsx.pieces(io.BytesIO(odd), 300) for r in xlsx.parsed(p)] == whole
    bare = xlsx._NUMBER.sub(b"", xml)
    assert [k for p in xlsx.pieces(io.BytesIO(bare), 300) for k, _ in xlsx.parsed(p)] == list(range(len(rows)))
    assert list(xlsx.pieces(io.BytesIO(b"<worksheet><sheetData/></worksheet>"))) == [] == list(xlsx.pieces(io.BytesIO(b"")))


def test_source_reads_pieces_columns_and_filters(spark, tmp_path):
    a, b = _cells(2), _cells(3, 40)
    _save(tmp_path / "a.xlsx", a)
    _save(tmp_path / "b.xlsx", b)
    _save(tmp_path / "none.xlsx", [])
    xlsx.register(spark)
    read = lambda: spark.read.format("xlsx").option("pieceBytes", 2000)
    got = read().load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r.path[-6], r.row_idx, list(r.cells)) for r in got.collect()) == sorted((f, k, c) for f, rows in (("a", a), ("b", b)) for k, c in _want(rows))
    some = read().schema("row_idx long, D string, A string").load(f"file://{tmp_path}/a.xlsx")
    assert {r.row_idx: (r.A, r.D) for r in some.collect()} == {k: (c[0] if c else None, c[3] if len(c) > 3 else None) for k, c in _want([x[:1] + [None, None] + x[3:4] if len(x) > 3 else x[:1] for x in a])}
    near = got.filter((F.col("path") == str(tmp_path / "a.xlsx")) & (F.col("row_idx") >= 250) & (F.col("row_idx") < 260) & (F.size("cells") > 0))
    assert "row_idx" not in near._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("\n")[0]
    assert sorted((r.row_idx, list(r.cells)) for r in near.collect()) == [x for x in _want(a)[250:260] if x[1]]
    assert got.filter("row_idx > 5 AND row_idx < 4").count() == 0 and got.filter("row_idx = 7").count() == 2
    with pytest.raises(Exception, match="no sheet"):
        read().option("sheet", "none").load(str(tmp_path)).count()


def test_sheets_of_any_store_and_writer(spark, tmp_path):
    table = spark.range(0, 2500, 1, 3).select("id", F.concat(F.lit("n & "), (F.col("id") % 50).cast("string")).alias("name"), F.when(F.col("id") % 4 > 0, F.col("id") * 0.5).alias("half"))
    xlsx.write_sheets(table, str(tmp_path / "w"), 500)
    assert len(list((tmp_path / "w").glob("part-*"))) == 6 and all(zipfile.ZipFile(p).testzip() is None for p in (tmp_path / "w").glob("part-*"))
    rows = xlsx.sheet_rows(spark, str(tmp_path / "w"), pattern="part-*", lot=3000)
    want = sorted((str(r.id), r.name, *([str(r.half)] if r.half is not None else [])) for r in table.collect())
    assert sorted(tuple(r.cells) for r in rows.collect()) == want
    only = xlsx.sheet_rows(spark, str(tmp_path / "w"), columns=["C", "A"], pattern="part-*")
    assert only.columns == ["path", "row_idx", "C", "A"] and sorted((r.A, r.C) for r in only.collect()) == sorted((str(r.id), None if r.half is None else str(r.half)) for r in table.collect())


def test_a_large_sheet_is_read_by_several_tasks(spark, tmp_path):
    _save(tmp_path / "large.xlsx", ([k, "x", None, f"t{k % 100}"] for k in range(150_000)))
    xlsx.register(spark)
    rows = spark.read.format("xlsx").option("pieceBytes", 2 << 20).schema("row_idx long, D string").load(str(tmp_path / "large.xlsx"))
    by = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(by) >= 4 and sum(r.n for r in by) == 150_000 and max(r.n for r in by) < 60_000
    assert rows.filter("D <> concat('t', cast(row_idx % 100 AS string))").isEmpty()

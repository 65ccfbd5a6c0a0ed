"""Ragged sheet rows (row_idx, cells) to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import codes, text

#: Words of rows that carry no data.
HEADERS, CONTINUED, TABLE_TITLE, BOOK_TITLE = ["大类", "中类"], "续表", "分类体系表", "职业分类大典"


def is_junk(cells: Column) -> Column:
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    marked = F.exists(cells, lambda c: (plain(c) == CONTINUED) | (plain(c) == TABLE_TITLE) | F.contains(plain(c), F.lit(BOOK_TITLE)))
    blank = ~F.exists(cells, lambda c: text.squeezed(c) != "")
    return blank | F.coalesce(F.get(cells, F.lit(0)).isin(HEADERS), F.lit(False)) | marked


def is_detail(cells: Column) -> Column:
    e, f = F.get(cells, F.lit(4)), F.get(cells, F.lit(5))
    return (F.size(cells) > 5) & (text.squeezed(e) != "") & (text.squeezed(f) != "") & (e != CONTINUED) & (f != CONTINUED)


def _lines(cell: Column) -> Column:
    return F.filter(F.transform(F.split(cell, "\n"), text.squeezed), lambda x: x != "")


def detail_records(rows: DataFrame) -> DataFrame:
    """row_idx, pos, code, name: codes of three dashes paired with names by place, as far as both go."""
    kept = rows.filter(~is_junk(F.col("cells")) & is_detail(F.col("cells")))
    listed = kept.select("row_idx", F.filter(_lines(F.get("cells", F.lit(4))), lambda c: codes.dashes(c) == 3).alias("c"), _lines(F.get("cells", F.lit(5))).alias("n"))
    short = F.least(F.size("c"), F.size("n"))
    pairs = F.arrays_zip(F.slice("c", F.lit(1), short), F.slice("n", F.lit(1), short))
    return listed.select("row_idx", F.posexplode(pairs).alias("pos", "p")).select("row_idx", "pos", F.col("p.0").alias("code"), F.col("p.1").alias("name"))


def detail_records_of(rows: DataFrame, smalls: DataFrame) -> DataFrame:
    """small, row_idx, pos, code, name: codes right below a small class, paired with all names of their row by place.

    The prefix test is an equi-join on the code's parent, not a loop over small classes.
    """
    kept = rows.filter(is_detail(F.col("cells")))
    found = kept.select("row_idx", F.posexplode(_lines(F.get("cells", F.lit(4)))).alias("at", "code"), _lines(F.get("cells", F.lit(5))).alias("names"))
    found = found.filter(F.substring_index("code", "-", -1).rlike(r"^[0-9]+\z")).withColumn("small", codes.parent_code(F.col("code"))).join(smalls.select(F.col("code").alias("small")).distinct(), "small")
    listed = found.groupBy("small", "row_idx").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c"), F.first("names").alias("names"))
    return listed.select("small", "row_idx", "names", F.posexplode("c").alias("pos", "x")).select("small", "row_idx", "pos", F.col("x.code").alias("code"), F.get("names", F.col("pos")).alias("name")).filter("name is not null")


def skeleton_text(cells: Column) -> Column:
    return F.array_join(F.slice(cells, 1, 4), " ")


def skeleton_cells(rows: DataFrame) -> DataFrame:
    return rows.select("row_idx", F.posexplode(F.slice("cells", 1, 4)).alias("col", "text"))


def skeleton_records(rows: DataFrame) -> DataFrame:
    """row_idx, pos, code, gbm_code, name of every code found in columns A to D."""
    texts = rows.filter(~is_junk(F.col("cells"))).select("row_idx", F.posexplode(text.record_texts(skeleton_text(F.col("cells")))).alias("pos", "t"))
    return texts.select("row_idx", "pos", text.parsed_cell(F.col("t")).alias("p")).filter("p is not null").select("row_idx", "pos", "p.*")


def row_pairs(rows: DataFrame) -> DataFrame:
    """row_idx, pos, code, name: non-blank lines of columns E and F paired by place as far as both go, whatever the codes; continued tables have none."""
    e, f = (text.squeezed(F.get("cells", F.lit(k))) for k in (4, 5))
    kept = rows.filter((F.size("cells") > 5) & (e != CONTINUED) & (f != CONTINUED))
    listed = kept.select("row_idx", *[_lines(F.get("cells", F.lit(k))).alias(c) for k, c in ((4, "c"), (5, "n"))])
    short = F.least(F.size("c"), F.size("n"))
    pairs = F.arrays_zip(F.slice("c", F.lit(1), short), F.slice("n", F.lit(1), short))
    return listed.select("row_idx", F.posexplode(pairs).alias("pos", "p")).select("row_idx", "pos", F.col("p.0").alias("code"), F.col("p.1").alias("name"))


def skeleton_of_cells(rows: DataFrame) -> DataFrame:
    """row_idx, col, pos, code, gbm (a number), name, level: each cell's major class, then the middle and small classes that it names."""
    cells = skeleton_cells(rows.filter(~is_junk(F.col("cells")))).withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", "")).filter("text <> ''")
    major = cells.select("row_idx", "col", F.lit(-1).alias("pos"), text.major_class(F.col("text")).alias("p"))
    other = cells.select("row_idx", "col", F.posexplode(text.record_texts(F.col("text"))).alias("pos", "t")).select("row_idx", "col", "pos", text.parsed_cell(F.col("t"), "").alias("p"))
    level = codes.level_of_skeleton(F.col("p.code"))
    both = major.filter("p is not null").withColumn("level", F.lit(codes.LEVELS[0])).unionByName(other.filter("p is not null").withColumn("level", level).filter(F.col("level").isin(codes.LEVELS[1:3])))
    return both.select("row_idx", "col", "pos", F.col("p.code").alias("code"), text.gbm_number(F.col("p.gbm_code")).alias("gbm"), F.col("p.name").alias("name"), "level")


def packs(rows: DataFrame, smalls: DataFrame) -> DataFrame:
    """parent_code, parent_name, codes, names: the detail lines below each small class, in order; classes without any have no pack."""
    found = detail_records_of(rows, smalls)
    packed = found.groupBy("small").agg(F.sort_array(F.collect_list(F.struct("row_idx", "pos", "code", "name"))).alias("x"))
    return smalls.select(F.col("code").alias("small"), F.col("name").alias("parent_name")).join(packed, "small").select(F.col("small").alias("parent_code"), "parent_name", F.col("x.code").alias("codes"), F.col("x.name").alias("names"))


def hybrid(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skeleton, packs, statistics) of a sheet in one scan's terms: classes named in cells, detail lines below the small ones, and how many there are."""
    skeleton = skeleton_of_cells(rows)
    smalls = skeleton.filter(F.col("level") == codes.LEVELS[2]).groupBy("code").agg(F.min(F.struct("row_idx", "col", "pos", "name"))["name"].alias("name"))
    packed = packs(rows, smalls)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return skeleton, packed, count(rows, "rows").unionByName(count(skeleton, "skeleton")).unionByName(count(packed, "tasks"))


def records(rows: DataFrame) -> DataFrame:
    """Skeleton records first, then details, with their source's number."""
    a = skeleton_records(rows).select(F.lit(0).alias("source"), "row_idx", "pos", "code", "gbm_code", "name")
    b = detail_records(rows).select(F.lit(1).alias("source"), "row_idx", "pos", "code", F.lit("").alias("gbm_code"), "name")
    return a.unionByName(b)

"""Layout blocks of pages: (task_id, page_num, block_num, text, x0, y0, x1, y1, font, font_size, flags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import order as O

#: Signs of an occupation's name, gaps of indents, and bounds of a page's margins.
JOB_WORDS = "员|师|工|长|家|人员|技术|管理|操作|专员|主管"
INDENT_GAP, INDENT_NEAR, MAX_LEVEL = 15, 10, 4


def from_pages(pages: DataFrame) -> DataFrame:
    """Blocks of nested pages (blocks > lines > spans), non-blank spans only, numbered from 0 in each page."""
    block = pages.select("task_id", "page_num", F.posexplode("blocks").alias("b", "block"))
    line = block.select("task_id", "page_num", "b", F.posexplode("block.lines").alias("l", "line"))
    span = line.select("task_id", "page_num", "b", "l", F.posexplode("line.spans").alias("s", "span")).filter(T.squeezed(F.col("span.text")) != "")
    number = Window.partitionBy("task_id", "page_num").orderBy("b", "l", "s")
    box = lambda k: F.get("span.bbox", F.lit(k))
    return span.select("task_id", "page_num", (F.row_number().over(number) - 1).alias("block_num"), F.col("span.text").alias("text"), *[box(k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("span.font").alias("font"), F.col("span.size").alias("font_size"), F.col("span.flags").alias("flags"))


def derived(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "*", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), ((F.col("x0") + F.col("x1")) / 2).alias("center_x"), ((F.col("y0") + F.col("y1")) / 2).alias("center_y"),
        F.col("x0").alias("indentation"), (F.col("flags").bitwiseAND(16) != 0).alias("is_bold"), (F.col("flags").bitwiseAND(2) != 0).alias("is_italic"), F.nullif(T.occupation_code(F.col("text")), F.lit("")).alias("occupation_code"),
    )


def is_occupation_name(text: Column) -> Column:
    share = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}]", "")) / F.nullif(F.length(text), F.lit(0))
    return ~text.rlike(r"^[0-9\s.-]+\z") & (text.rlike(JOB_WORDS) | F.coalesce(share > 0.5, F.lit(False)))


def indent_levels(indents: Column) -> Column:
    """From sorted indents those over INDENT_GAP from the last one kept, MAX_LEVEL at most."""
    fold = F.aggregate(indents, F.array().cast("array<double>"), lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).when(x - F.element_at(kept, -1) > INDENT_GAP, F.concat(kept, F.array(x))).otherwise(kept))
    return F.slice(fold, 1, MAX_LEVEL)


def with_levels(blocks: DataFrame) -> DataFrame:
    """Adds hierarchy_level by rank of font size, indent and weight; sizes and indents are those of the task.

    Distinct sizes and indents are few; they are gathered by distinct aggregates and joined back.
    """
    sizes = blocks.filter("font_size > 0").groupBy("task_id").agg(F.slice(F.sort_array(F.collect_set("font_size"), False), 1, 3).alias("_sizes"))
    indents = blocks.filter("indentation > 0").groupBy("task_id").agg(indent_levels(F.array_sort(F.collect_set(F.col("indentation").cast("double")))).alias("_levels"))
    rows = blocks.join(sizes, "task_id", "left").join(indents, "task_id", "left")
    size, n = F.col("font_size"), F.coalesce(F.size("_sizes"), F.lit(0))
    at = lambda k: F.get("_sizes", F.lit(k))
    by_size = F.when((size > 0) & (size >= at(0)), 1).when((size > 0) & (n >= 2) & (size >= at(1)), 2).when((size > 0) & (n >= 3) & (size >= at(2)), 3).otherwise(MAX_LEVEL)
    near = F.array_position(F.transform("_levels", lambda x: F.abs(F.col("indentation") - x) < INDENT_NEAR), True)
    by_indent = F.when(near > 0, near - 1).when(F.col("indentation") > F.element_at("_levels", -1), F.size("_levels")).otherwise(0)
    rows = rows.withColumn("_l", F.least(by_size + F.when(F.col("_levels").isNull() | (F.size("_levels") == 0), 0).otherwise(by_indent), F.lit(MAX_LEVEL)).cast("int"))
    return rows.withColumn("hierarchy_level", F.when(F.col("is_bold") & (F.col("_l") > 1), F.col("_l") - 1).otherwise(F.col("_l"))).drop("_l", "_sizes", "_levels")


def matched(blocks: DataFrame, ahead: int = 4) -> DataFrame:
    """Blocks with a code, and name and confidence of the first fitting block of the next few of the task.

    Blocks are numbered through a task's pages and looked at in lots that know the next ones, so that a task of very
    many pages is not one window.
    """
    placed = O.numbered(blocks, ["task_id"], F.col("page_num"), ["block_num"], "_n", 1 << 10)
    seen = O.over_frame(placed, ["task_id"], lambda w: {"_next": F.array(*[F.lead(F.struct("text", "center_y"), k).over(w) for k in range(1, ahead + 1)])}, after=ahead, name="_n").filter("occupation_code is not null")
    y, height = F.col("center_y"), F.col("height")

    def judge(c):
        same = F.abs(c.center_y - y) < height
        named = is_occupation_name(c.text)
        score = F.when(same, F.when(named, 0.9)).when((c.center_y > y) & (c.center_y - y < height * 2) & named, 0.7)
        return F.struct(c.text.alias("name"), score.alias("confidence"))

    hit = F.get(F.filter(F.transform(F.filter("_next", lambda c: c.isNotNull()), judge), lambda c: c.confidence.isNotNull()), F.lit(0))
    return seen.withColumn("_hit", hit).select(*[c for c in blocks.columns], F.col("_hit.name").alias("occupation_name"), F.col("_hit.confidence").alias("confidence"))


def summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("page_num").alias("n_pages"), F.count("occupation_code").alias("n_code_blocks"), F.countDistinct("occupation_code").alias("n_codes"), F.countDistinct("font").alias("n_fonts"))


def level_distribution(blocks: DataFrame) -> DataFrame:
    """Counts of levels 1 to 4, zeros included."""
    levels = blocks.sparkSession.range(1, MAX_LEVEL + 1).select(F.col("id").cast("int").alias("hierarchy_level"))
    return levels.join(blocks.groupBy("hierarchy_level").agg(F.count(F.lit(1)).alias("n")), "hierarchy_level", "left").select("hierarchy_level", F.coalesce("n", F.lit(0)).alias("n_blocks"))


def fonts(blocks: DataFrame, most: int = 10) -> DataFrame:
    return blocks.groupBy("font", "font_size").agg(F.count(F.lit(1)).alias("n_blocks")).orderBy(F.desc("n_blocks"), "font", "font_size").limit(most)


def layout(blocks: DataFrame) -> DataFrame:
    """Sizes, indents and pages of each task; sizes and indents of 0 do not count."""
    some = F.when(F.col("font_size") > 0, F.col("font_size"))
    indents = F.array_sort(F.collect_set(F.when(F.col("indentation") > 0, F.col("indentation"))))
    return blocks.groupBy("task_id").agg(F.min(some).alias("min_size"), F.max(some).alias("max_size"), F.countDistinct("page_num").alias("n_pages"), F.size(indents).alias("n_indents"), F.array_join(F.slice(indents.cast("array<string>"), 1, 5), ",").alias("top_indents"))


def examples(blocks: DataFrame, n: int = 3) -> DataFrame:
    """The first n blocks of each level of a task, null and 0 read as the last level."""
    level = F.when(F.coalesce("hierarchy_level", F.lit(0)) == 0, MAX_LEVEL).otherwise(F.col("hierarchy_level"))
    place = Window.partitionBy("task_id", "level").orderBy("page_num", "block_num")
    return blocks.withColumn("level", level).withColumn("k", F.row_number().over(place)).filter(F.col("k") <= n).select("task_id", "level", "k", T.preview(F.col("text")).alias("preview"))


def size_levels(blocks: DataFrame) -> DataFrame:
    """task_id, font_size, level: the three largest sizes are levels 1 to 3, others the last one."""
    sizes = blocks.filter("font_size > 0").select("task_id", "font_size").distinct()
    place = F.dense_rank().over(Window.partitionBy("task_id").orderBy(F.desc("font_size")))
    return sizes.withColumn("level", F.when(place <= 3, place).otherwise(MAX_LEVEL))


def page_of(blocks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of blocks by page and number; limit is from 1 to 1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError(f"limit {limit} or offset {offset}")
    return blocks.orderBy("task_id", "page_num", "block_num").offset(offset).limit(limit)


def distinct_fonts(blocks: DataFrame) -> DataFrame:
    return blocks.select("font", "font_size").distinct()


def codes_in_order(blocks: DataFrame) -> DataFrame:
    return blocks.filter("occupation_code is not null").orderBy("task_id", "page_num", "block_num")


def page_texts(blocks: DataFrame, separator: str = "\n") -> DataFrame:
    """text of each page (task_id, page_num): its blocks' texts in order. A page's blocks are few by their nature."""
    rows = blocks.groupBy("task_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("block_num", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    return rows.select("task_id", "page_num", F.array_join("x.text", separator).alias("text"))


def page_fonts(blocks: DataFrame) -> DataFrame:
    """Each page's most used font (least name of those that tie) and its number of sizes."""
    n = blocks.groupBy("task_id", "page_num", "font").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("task_id", "page_num").agg(F.min_by("font", F.struct(-F.col("n"), "font")).alias("primary_font"), F.sum("n").alias("n_blocks"))
    return top.join(blocks.groupBy("task_id", "page_num").agg(F.countDistinct("font_size").alias("n_sizes")), ["task_id", "page_num"])


def page_layout(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Header, footer, columns and tables of each page."""
    key = ["task_id", "page_num"]
    low, high = height * 0.1, height * 0.9
    inner = blocks.filter((F.col("y0") > low) & (F.col("y0") < high))
    gap = F.col("x0") - F.lag("x0").over(Window.partitionBy(*key).orderBy("x0", "block_num"))
    gaps = inner.select(*key, gap.alias("gap")).groupBy(*key).agg(F.count(F.when(F.col("gap") > width * 0.1, 1)).alias("n_gaps"))
    edges = blocks.groupBy(*key).agg(F.max(F.col("y0") < low).alias("has_header"), F.max(F.col("y0") > high).alias("has_footer"), F.count(F.lit(1)).alias("n_blocks"))
    lines = blocks.groupBy(*key, F.bround("y0", 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max("n").alias("most"))
    out = edges.join(lines, key).join(gaps, key, "left")
    return out.select(*key, "has_header", "has_footer", F.least(F.coalesce("n_gaps", F.lit(0)) + 1, F.lit(3)).cast("int").alias("n_columns"), F.when((F.col("n_blocks") > 3) & (F.col("most") >= 3), 1).otherwise(0).alias("n_tables"), "n_blocks")


def filtered(blocks: DataFrame, page: int | None = None, level: int | None = None, has_code: bool | None = None, sizes: tuple | None = None) -> DataFrame:
    out = blocks if page is None else blocks.filter(F.col("page_num") == page)
    out = out if level is None else out.filter(F.col("hierarchy_level") == level)
    out = out if has_code is None else out.filter(F.col("occupation_code").isNotNull() == F.lit(has_code))
    return out if sizes is None else out.filter(F.col("font_size").between(*sizes))

"""Snapshots of pages: one row for each page with its contents, fonts and layout, and statistics of a task's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import blocks as B


def snapshots(blocks: DataFrame, pages: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """A row for each page (task_id, page_num from 1): counts of blocks, images and tables, the font used most, sizes with their counts, header, footer, columns.

    pages has task_id, page_num from 0, image_size and n_images; a page without blocks is one without contents.
    """
    key = ["task_id", "page_num"]
    size = F.bround("font_size").cast("int")
    sizes = blocks.filter(size > 0).groupBy(*key, size.alias("size")).agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("font_sizes"))
    fonts = B.page_fonts(blocks).select(*key, "primary_font")
    layout = B.page_layout(blocks, width, height)
    out = pages.join(layout, key, "left").join(fonts, key, "left").join(sizes, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "task_id", (F.col("page_num") + 1).alias("page_num"), "image_size", zero("n_blocks").alias("text_blocks_count"), "n_images", zero("n_tables").alias("tables_count"), "primary_font", "font_sizes",
        F.coalesce("has_header", F.lit(False)).alias("has_header"), F.coalesce("has_footer", F.lit(False)).alias("has_footer"), F.coalesce("n_columns", F.lit(1)).alias("columns_count"),
    )


def statistics(rows: DataFrame) -> DataFrame:
    """Storage, contents, fonts and layout of each task's snapshots; fonts and columns are maps of few keys, with their pages."""
    n = F.count(F.lit(1))
    flag = lambda c: F.count(F.when(F.col(c), 1))
    totals = rows.groupBy("task_id").agg(
        n.alias("total_pages"), F.sum("image_size").alias("total_size"), F.bround(F.sum("image_size") / 1024 / 1024, 2).alias("total_size_mb"), F.bround(F.sum("image_size") / n / 1024, 2).alias("average_size_kb"),
        F.sum("text_blocks_count").alias("total_text_blocks"), F.sum("n_images").alias("total_images"), F.sum("tables_count").alias("total_tables"),
        F.bround(F.sum("text_blocks_count") / n, 1).alias("avg_text_blocks_per_page"), F.bround(F.sum("n_images") / n, 1).alias("avg_images_per_page"), flag("has_header").alias("pages_with_header"), flag("has_footer").alias("pages_with_footer"),
    )

    def usage(column, name):
        counts = rows.filter(F.col(column).isNotNull()).groupBy("task_id", column).agg(n.alias("n"))
        return counts.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    return totals.join(usage("primary_font", "font_usage"), "task_id", "left").join(usage("columns_count", "column_distribution"), "task_id", "left")


def rollup(rows: DataFrame) -> DataFrame:
    """Pages, bytes and mean blocks of each task."""
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("image_size").alias("total_size"), F.avg("text_blocks_count").alias("avg_text_blocks"))


def by_page(rows: DataFrame, task_id=None, page: int | None = None) -> DataFrame:
    out = rows if task_id is None else rows.filter(F.col("task_id") == task_id)
    return (out if page is None else out.filter(F.col("page_num") == page)).orderBy("task_id", "page_num")

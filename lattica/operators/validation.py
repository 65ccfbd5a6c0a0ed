"""Checks of documents by tiers, over page rows (doc, page_num, width, height, text, ...) and file rows (path, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T

#: The largest file, pages whose fonts are looked at, fields that metadata should have, sizes that may differ.
MOST_BYTES, FONT_PAGES, METADATA, MOST_SIZES = 50 << 20, 5, ("Title", "Author", "Creator"), 2


def file_errors(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Adds errors: missing (a null length), too large, empty."""
    return files.withColumn("errors", F.array_compact(F.array(F.when(F.col("length").isNull(), "missing"), F.when(F.col("length") > most, "too large"), F.when(F.col("length") == 0, "empty"))))


def expected(names: DataFrame, files: DataFrame) -> DataFrame:
    """Files by the names wanted, with a null length for those that are not there."""
    return names.join(files, "name", "left")


def page_info(pages: DataFrame) -> DataFrame:
    """Facts of each page (from 1): size, length of its text, whether it has images."""
    return pages.select("doc", (F.col("page_num") + 1).alias("page_number"), "width", "height", F.length(F.coalesce("text", F.lit(""))).alias("text_length"), (F.coalesce(F.size("images"), F.lit(0)) > 0).alias("has_images"))


def accessibility(facts: DataFrame) -> DataFrame:
    """Whether a document has a structure (contents), and what is missing; tags, texts of images and reading order are not known."""
    return facts.select("doc", F.col("has_toc").alias("has_structure"), F.array_compact(F.array(F.when(~F.col("has_toc"), "no structure"))).alias("issues"))


def page_facts(pages: DataFrame) -> DataFrame:
    """n_pages, text_length (pages joined by a line feed), pages_with_text, n_sizes, area of each document."""
    size = F.struct("width", "height")
    length = F.length(F.coalesce("text", F.lit("")))
    blank = T.squeezed(F.coalesce("text", F.lit(""))) == ""
    return pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_pages"), (F.sum(length) + F.count(F.lit(1)) - 1).alias("text_length"), F.count(F.when(length > 0, 1)).alias("pages_with_text"), F.max(~blank).alias("has_text"),
        F.countDistinct(size).alias("n_sizes"), F.sum(F.col("width") * F.col("height")).alias("sum_area"),
    )


def quality(facts: DataFrame) -> DataFrame:
    n = F.nullif(F.col("n_pages"), F.lit(0))
    return facts.select(
        "doc", F.coalesce(F.col("text_length") / n, F.lit(0.0)).alias("text_to_page_ratio"), F.coalesce(F.col("sum_area") / n, F.lit(0.0)).alias("average_page_size"),
        (F.col("n_sizes") <= MOST_SIZES).alias("consistent_page_sizes"), F.coalesce(F.col("pages_with_text") / n, F.lit(0.0)).alias("text_success_rate"),
    )


def verdict(facts: DataFrame, metadata: list[str] | tuple = (), strict: bool = False) -> DataFrame:
    """is_valid, errors and warnings of each document; metadata names columns of facts, checked if strict."""
    no_page, no_text = F.col("n_pages") == 0, ~F.coalesce("has_text", F.lit(False))
    warnings = [F.when(no_page, "no page"), F.when(no_text, "no text")]
    errors = [F.when(no_text, "text is required"), F.when(no_page, "a page is required")] if strict else []
    warnings += [F.when(~T.has_value(F.col(m)), f"no {m}") for m in metadata] if strict else []
    out = facts.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.withColumn("is_valid", F.size("errors") == 0)


def structure(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """has_toc, toc_entries and max_toc_level of each document, by its contents' entries (doc, level)."""
    of = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("toc_entries"), F.max("level").alias("max_toc_level"))
    joined = documents.select("doc").join(of, "doc", "left")
    return joined.select("doc", F.col("toc_entries").isNotNull().alias("has_toc"), F.coalesce("toc_entries", F.lit(0)).alias("toc_entries"), F.coalesce("max_toc_level", F.lit(0)).alias("max_toc_level"))


def fonts_embedded(fonts: DataFrame, most: int = FONT_PAGES) -> DataFrame:
    """Whether all fonts of a document's first pages are embedded, and the pages (from 1) where one is not."""
    near = fonts.filter(F.col("page_num") < most)
    return near.groupBy("doc").agg(F.bool_and("embedded").alias("fonts_embedded"), F.array_sort(F.collect_set(F.when(~F.col("embedded"), F.col("page_num") + 1))).alias("issue_pages"))


def integrity(pages: DataFrame) -> DataFrame:
    """Pages that could not be read, of each document; a page's error is null where it could."""
    return pages.groupBy("doc").agg((F.count("error") == 0).alias("is_complete"), F.count("error").alias("n_failed"))


def images(pages: DataFrame) -> DataFrame:
    """A row for each image of a page."""
    return pages.select("doc", "page_num", F.posexplode("images").alias("image_index", "image")).select("doc", "page_num", "image_index", "image.*")


def by_type(errors: DataFrame, kind: str) -> DataFrame:
    """Errors (..., error) of a kind."""
    return errors.filter(F.col("error") == kind)

"""Two sources of the same codes: joins, choices and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import codes, text
from lattica.operators.hierarchy import first_wins, last_wins

BASE = 0.8  # fixed value: share of a source's confidence that is kept


def matched(rules: DataFrame, found: DataFrame) -> DataFrame:
    """rules (code, name) with the found item (seq, code, name) of the code, else of the name; the last one wins."""
    by_code = last_wins(found.select("code", "name", "seq")).select("code", F.col("name").alias("_by_code"))
    by_name = last_wins(found.select("name", "code", "seq"), key="name").select("name", F.col("code").alias("_code_by_name"))
    out = rules.join(by_code, "code", "left").join(by_name, "name", "left")
    how = F.when(F.col("_by_code").isNotNull(), "code").when(F.col("_code_by_name").isNotNull(), "name").otherwise("none")
    return out.select("code", "name", how.alias("matched_by"), F.when(F.col("_by_code").isNotNull(), F.col("_by_code")).when(F.col("_code_by_name").isNotNull(), F.col("name")).alias("found_name"))


def fused(rules: DataFrame, found: DataFrame) -> DataFrame:
    """code, rule_name, pdf_name of all codes of either source that have a name; missing names are ''."""
    both = rules.select("code", F.col("name").alias("rule_name")).join(last_wins(found.select("code", "name", "seq")).select("code", F.col("name").alias("pdf_name")), "code", "full")
    both = both.select("code", F.coalesce("rule_name", F.lit("")).alias("rule_name"), F.coalesce("pdf_name", F.lit("")).alias("pdf_name"))
    return both.filter((F.col("rule_name") != "") | (F.col("pdf_name") != ""))


def kind(fused_rows: DataFrame) -> DataFrame:
    r, p = F.col("rule_name"), F.col("pdf_name")
    return fused_rows.withColumn("kind", F.when(p == "", "rule_only").when(r == "", "pdf_only").when(r == p, "same").otherwise("name_diff"))


def match_counts(rules: DataFrame, found: DataFrame) -> DataFrame:
    """How many rules have a found item, by code or name, and how many have none."""
    hit = F.col("matched_by") != "none"
    return matched(rules, found).agg(F.count(F.when(hit, 1)).alias("n_matched"), F.count(F.when(~hit, 1)).alias("n_unmatched"))


def confidence(rule: Column, pdf: Column) -> Column:
    return F.when((rule > 0) & (pdf > 0), BASE * (rule + pdf) / 2).when(rule > 0, BASE * rule).when(pdf > 0, BASE * pdf * 0.8).otherwise(F.lit(BASE))


def from_pdf(found: DataFrame) -> DataFrame:
    """Items of a PDF (code, name, level, confidence) as cleaned items of their source."""
    return found.select("code", "name", "level", "confidence", F.lit("pdf_direct").alias("source"), F.lit("data_mapper").alias("processed_by"))


def transformed(choices: DataFrame, answers: DataFrame) -> DataFrame:
    """Choices (pos, code, rule_name, rule_confidence, parent_code, level) with the name and source that the answer (pos, answer) of their place gives, if it is JSON that has them as texts."""
    reply = F.from_json("answer", "map<string,string>")
    text_of = lambda k: F.when(F.get_json_object("answer", f"$.{k}").isNotNull() & F.col("answer").rlike(rf'"{k}"\s*:\s*"'), F.try_element_at(reply, F.lit(k)))
    own = answers.select("pos", text_of("name").alias("_name"), text_of("selected_from").alias("selected_from"))
    return choices.join(own, "pos", "left").select("pos", "code", F.coalesce("_name", "rule_name").alias("name"), "level", "parent_code", F.lit("semantic_transform").alias("source"), F.col("rule_confidence").alias("confidence"), "selected_from")


def staged(items: DataFrame) -> DataFrame:
    """Items (seq, code, name) grouped by major class, cleaned, validated and merged: names are normalised, items without
    a code or a name go, the first of equal codes stays, and groups follow each other by prefix."""
    grouped = items.withColumn("prefix", codes.main_category(F.col("code")))
    cleaned = grouped.withColumn("name", text.normalized_name(F.col("name")))
    valid = cleaned.filter(text.has_value(F.col("code")) & text.has_value(F.col("name")))
    return in_groups(first_wins(valid))


def in_groups(rows: DataFrame) -> DataFrame:
    """Rows of all groups, by prefix and then in their own order."""
    return rows.orderBy("prefix", "seq")


def chosen(choices: DataFrame, answers: DataFrame) -> DataFrame:
    """Choices with the answer's name, or the rule's with confidence 0.5 where there is no answer."""
    out = choices.join(answers, "code", "left")
    source = F.coalesce("selected_from", F.lit("default"))
    return out.select(
        "code", F.coalesce("selected_name", "rule_name").alias("name"), F.when(F.col("selected_from").isNull() | (source == "rule"), F.col("pdf_name")).otherwise(F.col("rule_name")).alias("alternative"),
        F.when(F.col("selected_from").isNull(), 0.5).otherwise(confidence(F.col("rule_confidence"), F.col("pdf_confidence"))).alias("confidence"), source.alias("selected_from"),
    )

"""Functions of hierarchical codes ("1", "1-01", "1-01-00", "1-01-00-01"): Column to Column, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names by number of dashes, and the names for anything else.
LEVELS = ["大类", "中类", "小类", "细类"]
UNKNOWN_BY_DASHES = "未知级别"
UNKNOWN_BY_NUMBER = "未知层级"


def dashes(code: Column) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit("-"), F.lit("")))


def _named(number: Column, names: list[str], other: Column) -> Column:
    out = F.when(number == 0, names[0])
    for k, name in enumerate(names[1:], 1):
        out = out.when(number == k, name)
    return out.otherwise(other)


def level_of(code: Column) -> Column:
    return _named(dashes(code), LEVELS, F.lit(UNKNOWN_BY_DASHES))


def level_name(level: Column) -> Column:
    return _named(level, LEVELS, F.lit(UNKNOWN_BY_NUMBER))


def level_of_parts(code: Column) -> Column:
    """By number of parts; the deepest level stands for all others."""
    return _named(dashes(code), LEVELS[:3], F.lit(LEVELS[3]))


def level_of_skeleton(code: Column) -> Column:
    return _named(dashes(code), LEVELS[:3], F.lit(""))


def level_int(code: Column) -> Column:
    return F.when(code == "", -1).otherwise(dashes(code))


def parent_code(code: Column) -> Column:
    return F.regexp_extract(code, r"^(.*)-[^-]*$", 1)


def main_category(code: Column) -> Column:
    return F.substring_index(code, "-", 1)


def is_valid_code(code: Column) -> Column:
    return code.rlike(r"^[0-9]+(-[0-9]+)*\z")


def is_detail_of(code: Column, small: Column) -> Column:
    return F.startswith(code, F.concat(small, F.lit("-"))) & F.substring(code, F.length(small) + 2, F.length(code)).rlike(r"^[0-9]+\z")


def is_valid_record(code: Column, name: Column, level: Column) -> Column:
    return (code != "") & (name != "") & level.between(0, 3)


def errors(code: Column, name: Column, level: Column) -> Column:
    """Array of "field:constraint" for what is wrong with a category."""
    return F.array_compact(
        F.array(
            F.when(code == "", F.lit("code:required")),
            F.when(name == "", F.lit("name:required")),
            F.when(level == "", F.lit("level:required")),
            F.when(~level.isin(LEVELS), F.lit("level:enum")),
            F.when(~is_valid_code(code), F.lit("code:format")),
        )
    )

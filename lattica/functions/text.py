"""Functions of messy cell text, JSON inside answers, and small projections: Column to Column, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters read as spaces besides carriage return, line feed and tab; patterns of codes in cells.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u3000"
_GBM = r"(?:\([ ]*GBM[ ]*([0-9]+)[ ]*\))?"
_BLANK = r"[ \t\n\f\r]"
CELL = rf"^(.*?)([0-9-]+)[ ]*{_GBM}[ ]*(.*)\z"
CODE_START = r"[0-9-]+(?:[ \t\n\f\r]*\([ \t\n\f\r]*GBM[ \t\n\f\r]*[0-9]+[ \t\n\f\r]*\))?"
MAJOR = rf"第[一二三四五六七八]大类{_BLANK}+([1-8]){_BLANK}*(?:\({_BLANK}*GBM{_BLANK}*([0-9]+){_BLANK}*\))?{_BLANK}*([^\n]*)\z"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), r"^ +| +\z", "")


def without_cjk_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[\x{4e00}-\x{9fff}])[ \t\n\f\r]+(?=[\x{4e00}-\x{9fff}])", "")


def normalized_name(text: Column) -> Column:
    return without_cjk_spaces(squeezed(F.translate(text, SPACES, " " * len(SPACES))))


def parsed_cell(text: Column, joiner: str = " ") -> Column:
    """struct(code, gbm_code, name) of a cell; null where it has no code. joiner stands between the name's parts."""
    t = squeezed(F.translate(text, "\u00a0", " "))
    trim = lambda c: F.regexp_replace(c, "^ +| +$", "")
    head, tail = trim(F.regexp_extract(t, CELL, 1)), trim(F.regexp_extract(t, CELL, 4))
    name = normalized_name(F.when((head != "") & (tail != ""), F.concat(head, F.lit(joiner), tail)).otherwise(F.concat(head, tail)))
    return F.when(t.rlike(CELL), F.struct(F.regexp_extract(t, CELL, 2).alias("code"), F.regexp_extract(t, CELL, 3).alias("gbm_code"), name.alias("name")))


def record_texts(text: Column) -> Column:
    """The texts from each code's start to the next one's."""
    return F.slice(F.split(F.regexp_replace(text, CODE_START, "\u0001$0"), "\u0001"), 2, 1_000_000)


def major_class(text: Column) -> Column:
    """struct(code, gbm_code, name) of a cell that names one of the eight major classes; null for others and for one without a name."""
    name = normalized_name(F.regexp_extract(text, MAJOR, 3))
    return F.when(text.rlike(MAJOR) & (name != ""), F.struct(F.regexp_extract(text, MAJOR, 1).alias("code"), F.regexp_extract(text, MAJOR, 2).alias("gbm_code"), name.alias("name")))


def gbm_number(text: Column) -> Column:
    """The digits of a text as a number, 0 without any."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def occupation_code(text: Column) -> Column:
    return F.regexp_extract(text, r"(?<![0-9A-Za-z_])([0-9]-[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z_])", 1)


def preview(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def unfenced(text: Column) -> Column:
    """Text without Markdown fences around JSON."""
    return F.regexp_replace(F.regexp_replace(squeezed(text), r"^```(?:json)?[ ]*", ""), r"[ ]*```\z", "")


def json_part(text: Column) -> Column:
    """From the first [ to the last ], else from the first { to the last }, else ''."""
    array = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(array != "", array).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def has_value(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


#: Terms of rate limits.
def is_rate_limited(code: Column, message: Column) -> Column:
    return (code == "429") | F.lower(message).rlike("rate limit|429|限流|限制")


#: Queues of task types.
QUEUES = {
    "excel_processing": "queue:excel", "ai_processing": "queue:ai", "rule": "queue:rule", "pdf": "queue:pdf",
    "llm-batch": "queue:llm-batch", "merger": "queue:merger", "semantic": "queue:semantic",
}


def queue_name(kind: Column, queues: dict[str, str] = QUEUES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in queues.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("queue:default"))


def md5_hex(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def megabytes(size: Column) -> Column:
    """Bytes as MB with two places, halves to even."""
    return F.bround(size / 1024 / 1024, 2)


def kilobytes(size: Column) -> Column:
    return F.bround(size / 1024, 2)


def mean_of(total: Column, n: Column) -> Column:
    """A mean with one place, halves to even; 0 of nothing."""
    return F.coalesce(F.bround(total / F.nullif(n, F.lit(0)), 1), F.lit(0.0))


def backoff_seconds(attempt: Column, cap: int = 30) -> Column:
    return F.least(attempt * attempt, F.lit(cap))

"""Chat formatting by a finite-state machine over roles (operator 3).

A declarative template lists, for each role, the segments of a turn: literals and the fields {text} and
{role}, each with a loss flag. Literals (without white space at their ends) are control strings; inside
fields each gets ESCAPE after its first character, and ESCAPE itself is doubled, so that no field holds a
control string and the output can be read back exactly.

The machine says which role may follow which. A turn out of order is formatted all the same; its row and
all later rows of the conversation have ok = false and a reason.

Defined results: null text, role: empty; turns are ordered by turn (null first), then role, then text, so
ties have a fixed order and repeated rows stay; unknown roles use the template's "other"; rows with null
conv_id form one conversation; an empty table gives an empty table; extra columns are not read. Rows of a
conversation stream through one task in order and are never held together.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ESCAPE = "\\"
TEMPLATE = {
    "system": [("<<SYS>>\n", False), ("{text}", False), ("\n<</SYS>>\n\n", False)],
    "user": [("[INST] ", False), ("{text}", False), (" [/INST]", False)],
    "assistant": [("{text}", True), ("</s>", False)],
    "other": [("<<TURN>>", False), ("{role}", False), ("<<SAYS>>", False), ("{text}", False), ("<</TURN>>", False)],
}
EXTRA_CONTROLS = ("<s>",)
NEXT = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
SCHEMA = "conv_id long, turn_no long, ok boolean, problem string, segments array<struct<text: string, loss: boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_NAMES = ["conv_id", "turn_no", "ok", "problem", "segments"]


class Template:
    def __init__(self, roles: dict[str, list[tuple[str, bool]]] = TEMPLATE, extra: tuple[str, ...] = EXTRA_CONTROLS):
        self.roles = roles
        fields = ("{text}", "{role}")
        self.controls = sorted({x.strip() for parts in roles.values() for x, _ in parts if x not in fields} | set(extra), key=lambda x: (-len(x), x))
        if any(len(x) < 2 or ESCAPE in x for x in self.controls):
            raise ValueError("a control string has two characters at least, and no escape")
        self._find = re.compile("|".join(map(re.escape, self.controls)))
        # The way back: a turn begins with its role's first literal; a role whose turn begins with {text} is the default.
        self._parse = []
        for role, parts in roles.items():
            pattern = "".join(f"(?P<{x[1:-1]}>.*?)" if x in fields else re.escape(x) for x, _ in parts)
            self._parse.append((parts[0][0] in fields, role, re.compile(pattern, re.DOTALL)))
        self._parse.sort(key=lambda x: x[0])

    def escape(self, text: str) -> str:
        return self._find.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        parts = self.roles.get(role) if role != "other" else None
        values = {"{text}": text, "{role}": role}
        return [(self.escape(values[x]) if x in values else x, loss) for x, loss in parts or self.roles["other"]]

    def take(self, formatted: str) -> tuple[list[tuple[str, str]], str]:
        """(role, text) of each whole turn from the beginning of a formatted text, and what is left behind them."""
        at, out = 0, []
        while at < len(formatted):
            for _, role, pattern in self._parse:
                if m := pattern.match(formatted, at):
                    found = m.groupdict()
                    out.append((self.unescape(found["role"]) if "role" in found else role, self.unescape(found["text"])))
                    at = m.end()
                    break
            else:
                break
        return out, formatted[at:]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        out, left = self.take(formatted)
        if left:
            raise ValueError(f"no turn at {len(formatted) - len(left)}")
        return out


def formatted(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each turn: its segments with loss flags, and what the machine says of it."""
    common.ship(turns.sparkSession)
    template = template or Template()

    def run(batches):
        conv, state, number, problem, begun = None, "", 0, None, False
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not begun or c != conv:
                    conv, state, number, problem, begun = c, "", 0, None, True
                if role not in NEXT.get(state, ()) and problem is None:
                    problem = f"{role or 'no role'} after {state or 'the start'}"
                rows.append((c, number, problem is None, problem, [{"text": x, "loss": y} for x, y in template.segments(role, text)]))
                state, number = role, number + 1
            if rows:
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), _SEGMENTS]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), common.text_of("role").alias("role"), common.text_of().alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, ok boolean, problem string"


def digests(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted rows back: a conversation's text as one, wherever rows end; keeps formatted()'s order, so nothing is shuffled again.

    Turns are taken as soon as they are whole, so that a long conversation is not held; text that is no turn raises.
    """
    template = template or Template()

    def run(batches):
        names, conv, state = [x.split()[0] for x in DIGEST.split(", ")], None, None

        def done(s):
            if s["left"]:
                raise ValueError(f"conversation {conv} ends in what is no turn: {s['left'][:50]!r}")
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["problem"] is None, s["problem"])

        for batch in batches:
            out = []
            for c, problem, segments in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(done(state))
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "problem": None, "left": ""}
                whole = "".join(x["text"] for x in segments)
                turns, state["left"] = template.take(state["left"] + whole)
                for role, text in turns:
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                for x in segments:
                    if x["loss"]:
                        text = template.unescape(x["text"])
                        state["loss"].update(text.encode())
                        state["loss_chars"] += len(text)
                state["chars"] += len(whole)
                state["problem"] = problem
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, done(state), strict=True))], _DIGEST)

    return rows.mapInArrow(run, DIGEST)


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_DIGEST = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in DIGEST.split(", ")])
PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(formatted(turns.unionByName(probe)))


# Controls, their number in a text and the literals' lengths are those of TEMPLATE.
_COUNT = " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)}" for x in Template().controls)
_PAD = {role: sum(len(x) for x, _ in parts if x[0] != "{") for role, parts in TEMPLATE.items()}
OP3_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, length(t) + (length(t) - length(replace(t, '\\', ''))) + {_COUNT}
    + CASE role WHEN 'system' THEN {_PAD["system"]} WHEN 'user' THEN {_PAD["user"]} WHEN 'assistant' THEN {_PAD["assistant"]}
      ELSE {_PAD["other"]} + length(role) END AS n,
    coalesce(lag(role) OVER w, '') AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)
), judged AS (
  SELECT *, CASE WHEN (before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
      OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') THEN NULL
    ELSE coalesce(nullif(role, ''), 'no role') || ' after ' || coalesce(nullif(before, ''), 'the start') END AS p FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(n) AS BIGINT) AS formatted_chars, count(p) = 0 AS ok, arg_min(p, (turn, role, t)) FILTER (p IS NOT NULL) AS problem
FROM judged GROUP BY conv_id
"""

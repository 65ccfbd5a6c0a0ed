"""Line-first cleaning (operator 9).

Each line with a word is judged by itself; failing lines are removed, and a document that loses more than
MAX_LOST of its words is rejected. A line fails if it
  - is symbols: more than one of #*$%&|<> for ten words;
  - is navigation: two or more of | > » › •, one for three words at least, or at most SHORT words without end punctuation
    in a document of more than one line;
  - shouts: three words or more, and more than half of its ASCII letters are capitals;
  - lacks punctuation: more than UNPUNCTUATED words without one of .!?;:, at all;
  - is boilerplate: it holds one of PHRASES as whole words;
  - equals an earlier line of the document.
Base rules over the whole text (too few words, repeated 8-word windows) reject as well.

Defined results: null text has no words and fails; very long texts are measured whole; repeated rows are
judged each; an empty table gives an empty table; extra columns are passed on by cleaned().
A null doc_id is passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SHORT, UNPUNCTUATED, MAX_LOST = 4, 40, 50
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "sign up for our", "click here", "read more", "log in",
    "sign in", "share this", "back to top", "skip to content", "follow us on", "powered by",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "newsletter abonnieren", "hier klicken", "mehr erfahren", "nach oben",
    "zum inhalt springen", "verwendet cookies", "folgen sie uns", "jetzt anmelden",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "cliquez ici", "lire la suite", "retour en haut",
    "aller au contenu", "utilise des cookies", "suivez nous", "se connecter",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "haga clic aquí", "leer más", "volver arriba",
    "ir al contenido", "utiliza cookies", "síguenos en", "iniciar sesión",
]
_table = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
SYMBOLS, NAV, ENDS, INNER = _table("#*$%&|<>"), _table("|>"), _table(".!?:;\"')]"), _table(".!?;:,")
UPPER, LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_NAV_WIDE = [s.encode() for s in "»›•"]
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _find(data: np.ndarray, needle: bytes) -> np.ndarray:
    """True where needle begins."""
    out = data == needle[0]
    for k, x in enumerate(needle[1:], 1):
        out[:-k] &= data[k:] == x
        out[-k:] = False
    return out


def _first_of(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, hash): its group, and whether it is the group's first."""
    key = kernel.mix(h ^ kernel.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    flag = np.zeros(len(h), bool)
    flag[first] = True
    return group, flag


def _phrases() -> dict[int, np.ndarray]:
    by: dict[int, list[int]] = {}
    for h in kernel.text_hashes(PHRASES):
        by.setdefault(len(h), []).append(int(kernel.gram_hashes(h, np.zeros(len(h), np.int64), len(h))[1][0]))
    return {n: np.array(x, np.uint64) for n, x in by.items()}


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(COLUMNS of each document, byte spans of the lines that stay, document of each)."""
    n = len(offsets) - 1
    starts, ends, doc = kernel.runs(kernel.NOT_SPACE[data], offsets)
    if not len(starts):
        return np.zeros((n, len(COLUMNS)), np.int64), np.empty((0, 2), np.int64), np.empty(0, np.int64)
    prefix = kernel.prefix_hash(data)
    words = kernel.span_hash(prefix, starts, ends)
    lead = (data & 0xC0) != 0x80
    n_words, word_chars = kernel.counts(doc, n), kernel.counts(doc, n, _sums(lead, starts, ends))
    n_symbols = _sums(SYMBOLS[data], offsets[:-1], offsets[1:])
    at, grams = kernel.gram_hashes(words, doc, WINDOW)
    cover = np.zeros(len(words) + 1, np.int64)
    if len(at):
        group, _ = _first_of(doc[at], grams)
        twice = at[np.bincount(group)[group] > 1]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
    n_repeat = kernel.counts(doc[np.cumsum(cover[:-1]) > 0], n)

    # Lines: spans between line feeds of one document; those with a word are judged.
    feeds = np.flatnonzero(data == 10)
    a = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    b = np.sort(np.concatenate([feeds, offsets[1:]]))
    line_of = np.searchsorted(a, starts, side="right") - 1
    per_line = np.bincount(line_of, minlength=len(a))
    full = per_line > 0
    index = np.cumsum(full) - 1
    line_of = index[line_of]
    a, b, w = a[full], b[full], per_line[full]
    owner = np.searchsorted(offsets, a, side="right") - 1
    last = np.zeros(len(a), np.int64)
    last[line_of] = ends  # the words come in order, so the last one stays
    letters, capitals = _sums(LETTER[data], a, b), _sums(UPPER[data], a, b)
    nav = _sums(NAV[data] | np.logical_or.reduce([_find(data, x) for x in _NAV_WIDE]), a, b)
    _, first = _first_of(owner, kernel.span_hash(prefix, a, b))
    boiler = np.zeros(len(a), bool)
    s, e, _, h = kernel.word_hashes(data, offsets, kernel.ALNUM)
    own = np.searchsorted(a, s, side="right") - 1
    for k, known in _PHRASE_HASHES.items():
        at, grams = kernel.gram_hashes(h, own, k)
        boiler[own[at[np.isin(grams, known)]]] = True
    several = np.bincount(owner, minlength=n)[owner] > 1
    lost = (
        (10 * _sums(SYMBOLS[data], a, b) > w)
        | ((nav >= 2) & (3 * nav >= w))
        | (several & (w <= SHORT) & ~ENDS[data[last - 1]])
        | ((w >= 3) & (2 * capitals > letters))
        | ((w > UNPUNCTUATED) & (_sums(INNER[data], a, b) == 0))
        | boiler
        | ~first
    )
    table = np.stack([n_words, word_chars, n_symbols, kernel.counts(owner[~first], n), n_repeat, kernel.counts(owner[lost], n, w[lost])], axis=1)
    return table, np.stack([a[~lost], b[~lost]], axis=1), owner[~lost]


_PHRASE_HASHES = _phrases()


def _verdicts(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, repeated, lost = table[:, 0], table[:, 4], table[:, 5]
    failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)
    return failed, ~failed & (100 * lost <= MAX_LOST * words)


def _strings(data: np.ndarray, spans: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
    body, bounds = data.tobytes(), np.searchsorted(owner, np.arange(n + 1))
    spans = spans.tolist()
    return [b"\n".join(body[a:b] for a, b in spans[bounds[k] : bounds[k + 1]]).decode() for k in range(n)]


def _judge(with_text: bool):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(1)):
                table, spans, owner = measure(data, offsets)
                failed, kept = _verdicts(table)
                columns = [batch.column(0).slice(a, b - a), *(pa.array(x) for x in table.T), pa.array(failed), pa.array(kept)]
                names = ["row_key", *COLUMNS, "base_failed", "kept"]
                if with_text:
                    columns.append(pa.array(_strings(data, spans, owner, b - a), pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


_FIELDS = ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def judged(docs: DataFrame) -> DataFrame:
    """doc_id with the measures and the verdict."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("row_key"), common.text_of().alias("text"))
    return rows.mapInArrow(_judge(False), f"row_key long, {_FIELDS}").withColumnRenamed("row_key", "doc_id")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns; text has lost its failing lines and n_chars follows, if there."""
    common.ship(docs.sparkSession)
    schema = docs.schema
    text_at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(text_at)):
                table, spans, owner = measure(data, offsets)
                _, kept = _verdicts(table)
                part = batch.slice(a, b - a)
                text = pa.array(_strings(data, spans, owner, b - a), part.schema.field(text_at).type)
                columns = [text if k == text_at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(kept))

    out = common.map_rows(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.read(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '{_W}') AS w FROM docs),
wins AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM words, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, {WINDOW})) AS u(k) GROUP BY r),
lines AS (SELECT r, p, l, len(regexp_extract_all(l, '{_W}')) AS w,
    length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(l, '[^|>»›•]', '', 'g')) AS nav,
    length(regexp_replace(l, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(l, '[^A-Z]', '', 'g')) AS capitals,
    ' ' || regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') || ' ' AS plain
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM docs)
  WHERE regexp_matches(l, '{_W}')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r, l ORDER BY p) AS k, count(*) OVER (PARTITION BY r) AS several FROM lines),
lost AS (SELECT r, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN 10 * sym > w OR (nav >= 2 AND 3 * nav >= w)
    OR (several > 1 AND w <= {SHORT} AND NOT regexp_matches(l, '[.!?:;"'')\\]][\\x20\\x09-\\x0D]*$'))
    OR (w >= 3 AND 2 * capitals > letters) OR (w > {UNPUNCTUATED} AND NOT regexp_matches(l, '[.!?;:,]')) OR k > 1
    OR {" OR ".join(f"contains(plain, ' {p} ')" for p in PHRASES)} THEN w ELSE 0 END) AS n FROM ranked GROUP BY r),
base AS (SELECT d.doc_id, cast(len(w.w) AS BIGINT) AS n_words, cast(length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    cast(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, cast(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
    cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, cast(coalesce(l.n, 0) AS BIGINT) AS n_lost_words
  FROM docs d JOIN words w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost l USING (r))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_lost_words <= {MAX_LOST} * n_words AS kept FROM base
"""

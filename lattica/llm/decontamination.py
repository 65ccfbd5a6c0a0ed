"""Benchmark decontamination by an FM-index for each training shard (operator 7).

A task cuts its documents into shards, indexes each shard's words and searches all benchmark windows in
it; nothing is shuffled. The index holds words of the benchmark's vocabulary; any run of other words is
one separator, as no window can cross it. Windows travel to the tasks in blocks of at most about BLOCK_BYTES of
benchmark text (or one longer item). A shard is indexed once, whatever the number of blocks: a task loads them one after
the other and holds one at a time, and a document's spans and items are those of all blocks together.

Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words; an item without words has no windows; an item with a
null id marks words but is not listed; items of the same id count once; repeated documents are judged
each; an empty benchmark marks nothing; decontaminated() passes extra columns on. A text of any length is one piece
of a shard; a task's memory follows a shard of SHARD_WORDS words or one longer text, and a block.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel
from .fm_index import FMIndex

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_BYTES = 8 << 20


class Windows:
    """The distinct windows of some benchmark items, as ends and sizes in the row of all items' symbols, and the items of each.

    A word of the benchmark takes some 26 bytes here, whatever the window.
    """

    def __init__(self, ids: list, texts: pa.Array, window: int):
        hashed, of = [], []
        for a, _, data, offsets in kernel.chunks(texts):
            _, _, doc, h = kernel.word_hashes(data, offsets, kernel.ALNUM)
            hashed.append(h)
            of.append(doc + a)
        h, of = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashed, np.uint64), (of, np.int64)))
        del hashed
        self.vocabulary, symbols = np.unique(h, return_inverse=True)
        self.symbols = (symbols + 1).astype(np.int32)
        del symbols
        each = kernel.counts(of, len(ids))
        size = np.minimum(each, window)
        first = np.cumsum(each) - each
        # A window ends at every word of an item but for the first size - 1.
        last = np.flatnonzero(np.arange(len(of)) - first[of] >= size[of] - 1)
        size = size[of[last]]
        # Windows are equal where the hashes of their words are.
        p, q = kernel._powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(kernel.mix(h) * p[: len(h)], out=total[1:])
        key = kernel.mix((total[last + 1] - total[last + 1 - size]) * q[last + 1 - size] + size.astype(np.uint64))
        del total, h
        _, where, group = np.unique(key, return_index=True, return_inverse=True)
        place = np.int32 if len(of) < 1 << 31 else np.int64
        self.last, self.sizes = last[where].astype(place), size[where].astype(np.int16)
        order = np.argsort(group, kind="stable")
        self.item_of = of[last][order].astype(np.int32)
        self.first = np.searchsorted(group[order], np.arange(len(where) + 1)).astype(place)
        self.ids = ids
        self.table_bytes = sum(x.nbytes for x in (self.vocabulary, self.symbols, self.last, self.sizes, self.item_of, self.first))


class Shard:
    """The FM-index of one shard's words, and what the blocks searched so far have hit in it."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, n: int, blocks: Blocks):
        self.doc, self.n_docs = doc, n
        self.cover = np.zeros(len(hashes) + 1, np.int64)
        self.found: list[set] = [set() for _ in range(n)]
        words, symbol = np.unique(hashes, return_inverse=True)
        known = np.zeros(len(words), bool)
        for w in blocks:
            known |= _within(words, w.vocabulary)
        self.vocabulary = words[known]
        number = np.zeros(len(words), np.int32)
        number[known] = np.arange(1, len(self.vocabulary) + 1)
        symbol = number[symbol]
        solid = symbol > 0
        # Known words, and one separator after each run of them.
        closes = solid & (np.append(doc[1:] != doc[:-1], True)[: len(doc)] | ~np.append(solid[1:], False)[: len(doc)])
        word = np.flatnonzero(solid)
        self.index = None
        if len(word):
            spot = np.arange(len(word)) + np.concatenate([[0], np.cumsum(closes[word])])[:-1]
            seq = np.zeros(int(spot[-1]) + 2, np.int32)
            self.origin = np.full(len(seq), -1, np.int64)
            seq[spot], self.origin[spot] = symbol[word], word
            self.index = FMIndex(seq, len(self.vocabulary))
            for w in reversed(blocks):
                self._search(w)

    def _search(self, w: Windows) -> None:
        at = np.searchsorted(self.vocabulary, w.vocabulary)
        at[at == len(self.vocabulary)] = 0
        symbols = np.where(self.vocabulary[at] == w.vocabulary, at + 1, 0)[w.symbols - 1]
        # A window with a word that the shard lacks is not in it.
        lacks = np.concatenate([[0], np.cumsum(symbols == 0)])
        some = np.flatnonzero(lacks[w.last + 1] == lacks[w.last + 1 - w.sizes.astype(np.int64)])
        lo, hi = self.index.search(symbols, w.last[some], w.sizes[some])
        times = hi - lo
        some, lo, times = some[times > 0], lo[times > 0], times[times > 0]
        if not len(some):
            return
        ends = np.cumsum(times)
        which = np.repeat(some, times)
        begin = self.origin[self.index.locate(np.repeat(lo - (ends - times), times) + np.arange(ends[-1]))]
        np.add.at(self.cover, begin, 1)
        np.add.at(self.cover, begin + w.sizes[which], -1)
        pairs = np.unique(self.doc[begin] * len(w.last) + which)
        owner, which = pairs // len(w.last), pairs % len(w.last)
        for d in np.unique(owner).tolist():
            own = which[np.searchsorted(owner, d) : np.searchsorted(owner, d, side="right")]
            items = np.unique(np.concatenate([w.item_of[w.first[x] : w.first[x + 1]] for x in own]))
            self.found[d].update(w.ids[k] for k in items.tolist() if w.ids[k] is not None)

    def hit(self) -> np.ndarray:
        """A flag for each word."""
        return np.cumsum(self.cover[:-1]) > 0


def _within(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Which words are in the sorted vocabulary."""
    if not len(vocabulary):
        return np.zeros(len(words), bool)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return vocabulary[at] == words


class Blocks:
    """The blocks' windows, broadcast each; a process holds the one that it loaded last."""

    def __init__(self, sent: list):
        self.sent = sent

    def _load(self, k: int) -> Windows:
        if getattr(self, "at", None) != k:
            self.held = None
            self.held, self.at = self.sent[k].value, k
            if len(self.sent) > 1:
                vars(self.sent[k]).pop("_value", None)  # a worker's broadcast keeps its value else
        return self.held

    def __iter__(self):
        return map(self._load, range(len(self.sent)))

    def __reversed__(self):
        return map(self._load, reversed(range(len(self.sent))))

    def __reduce__(self):
        return Blocks, (self.sent,)


def _shards(batches, column: int):
    """Lists of (batch slice, starts, ends, words' document, hashes) of about SHARD_WORDS words."""
    held, words = [], 0
    for batch in batches:
        for a, b, data, offsets in kernel.chunks(batch.column(column)):
            starts, ends, doc, h = kernel.word_hashes(data, offsets, kernel.ALNUM)
            held.append((batch.slice(a, b - a), starts - offsets[doc], ends - offsets[doc], doc, h))
            words += len(h)
            if words >= SHARD_WORDS:
                yield held
                held, words = [], 0
    if held:
        yield held


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """Merged runs of hit words of each document: first byte, end byte, words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if hit.any():
        edge = np.append(True, doc[1:] != doc[:-1])
        first = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
        last = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True))
        for d, a, b, k in zip(doc[first].tolist(), starts[first].tolist(), ends[last].tolist(), (last - first + 1).tolist(), strict=True):
            out[d].append((a, b, k))
    return out


def _search(blocks: Blocks, column: int, emit, batches):
    for held in _shards(batches, column):
        shift = np.cumsum([0, *(len(x[0]) for x in held)])
        doc = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=False)])
        shard = Shard(np.concatenate([x[4] for x in held]), doc, int(shift[-1]), blocks)
        spans = _spans(shard.hit(), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), doc, int(shift[-1]))
        total = kernel.counts(doc, int(shift[-1]))
        for (part, *_), s in zip(held, shift, strict=False):
            e = s + len(part)
            yield emit(part, total[s:e], spans[s:e], shard.found[s:e])


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
HITS = "doc_id long, n_words long, spans array<struct<first: long, end: long, words: long>>, items array<long>"


def _hits(part: pa.RecordBatch, total, spans, found) -> pa.RecordBatch:
    dicts = [[{"first": a, "end": b, "words": k} for a, b, k in x] for x in spans]
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(dicts, _SPAN), pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])


def parts(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark's rows in parts of about block_bytes of text at most; several are dealt once, so that each is read alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    if n == 1:
        return [items]
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    dealt = common.written(dealt.repartition("block").sortWithinPartitions("block"), "benchmark-blocks")
    return [dealt.filter(F.col("block") == k).drop("block") for k in range(n)]


def _sent(benchmark: DataFrame, window: int, block_bytes: int) -> Blocks:
    """Builds and broadcasts the blocks one by one."""
    sent = []
    for part in parts(benchmark, block_bytes):
        table = part.orderBy("item_id", "text").toArrow()
        sent.append(benchmark.sparkSession.sparkContext.broadcast(Windows(table.column(0).to_pylist(), kernel.as_array(table.column(1)), window)))
        del table
        kernel.release()
    return Blocks(sent)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged removal spans: bytes of the text and number of words), items; a row for each of docs."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(partial(_search, _sent(benchmark, window, block_bytes), 1, _hits), HITS)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _judged(part: pa.RecordBatch, at: int, total: np.ndarray, spans: list[list[tuple[int, int, int]]], cut: bool) -> pa.RecordBatch:
    n_hit = np.array([sum(s[2] for s in x) for x in spans], np.int64)
    bad = contaminated(n_hit, total)
    if not cut:
        return part.filter(pa.array(~bad))
    texts = part.column(at).to_pylist()
    for k in np.flatnonzero(bad):
        body, last, kept = texts[k].encode(), 0, []
        for a, b, _ in spans[k]:
            kept.append(body[last:a])
            last = b
        texts[k] = b"".join([*kept, body[last:]]).decode()
    return pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == at else c for k, c in enumerate(part.columns)], schema=part.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents; with cut, these stay without their removal spans instead."""
    common.ship(docs.sparkSession)
    at = docs.columns.index("text")
    return common.map_rows(docs, partial(_search, _sent(benchmark, window, block_bytes), at, lambda part, total, spans, found: _judged(part, at, total, spans, cut)))


def _digest(batches):
    for batch in batches:
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n_hit = [sum(s["words"] for s in x) for x in spans]
        sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    out = found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_W}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM items, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT r, i, n, item_id FROM spots JOIN wins USING (n, g)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM found), unnest(range(0, n)) AS u(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, cast(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

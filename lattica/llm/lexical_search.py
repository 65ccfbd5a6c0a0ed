"""Ranked lexical search (operator 12).

index() cuts documents into shards, where they are: a task gathers SHARD_TERMS terms, puts the shard's documents in order of
doc_id, and writes one row for each term with its postings (gaps of document numbers and frequencies, as bytes
of seven bits each), and one row, without a term, with the shard's ids and lengths. Nothing is shuffled. Counts of
the corpus are sums over these rows.

search() joins the terms of all queries to the index, so only their postings move, once, by shard and block of queries; terms are
broadcast if their measured size is at most BROADCAST_BYTES, else both sides are shuffled by term. A
shard's queries are then answered document by document: a heap over the cursors of a query's posting lists gives the
next document, whose terms are summed up and offered to a heap of the k best, keyed by score, then doc_id. Lists whose
greatest gains together can't lift a document over the k-th best are left out of the heap and only looked up, which
changes no result. The shards' best are merged by a window with a limit before the shuffle.

Defined results: null text has no terms; documents without terms are not found; each row is a document of its own, rows of one doc_id
too; null doc_ids come after all others where scores tie; a query is a distinct row of item_id and text, so repeated items
count once, and two texts under one id are two queries; a query without known terms has no results; empty tables give empty
tables; extra columns are not read. A text of any length is in one shard; a task's memory follows a shard or one longer text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernel

SHARD_TERMS = 2_000_000
QUERY_BLOCK = 1024  # queries that a task answers at once
BROADCAST_BYTES = 8 << 20  # of query terms and their uses; larger tables of terms are joined by a shuffle
K = 10
SCHEMA = "shard long, term string, df long, n_terms long, postings binary"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits each, the last below 128; and where each number begins, and the end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >> np.uint64(7 * k) > 0
        if not more.any():
            break
        size += more
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[:-1][own] + k] = (v[own] >> np.uint64(7 * k)).astype(np.uint8) & 127 | ((size[own] > k + 1) << 7).astype(np.uint8)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        own = ends - starts >= k
        out[own] |= (data[starts[own] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from spans of bytes."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    body = data[np.repeat(starts - at[:-1], ends - starts) + np.arange(int(at[-1]))]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))


def _rows(shard: int, ids: list, parts: list) -> pa.RecordBatch | None:
    """The index rows of one shard; ids of its documents, parts: bytes, term starts, ends, documents and hashes."""
    data = np.concatenate([x[0] for x in parts])
    starts, ends, doc, h = (np.concatenate([x[k] for x in parts]) for k in range(1, 5))
    each = kernel.counts(doc, len(ids))
    full = np.flatnonzero(each)
    if not len(full):
        return None
    order = np.array(sorted(full.tolist(), key=lambda d: (ids[d] is None, ids[d] or 0)))
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    _, first, term = np.unique(h, return_index=True, return_inverse=True)
    pairs, tf = np.unique(term * len(order) + place[doc], return_counts=True)
    term, number = pairs // len(order), pairs % len(order)
    df = np.bincount(term)
    new = np.append(True, term[1:] != term[:-1])
    body, at = packed(np.stack([np.where(new, number, number - np.append(0, number[:-1])), tf], axis=1).ravel())
    known = [ids[d] for d in order if ids[d] is not None]
    gaps = np.diff(np.array([0, *known], np.int64))
    if len(gaps):
        gaps[0] = gaps[0] << 1 ^ gaps[0] >> 63  # may be negative
    head, _ = packed(np.concatenate([[len(known)], gaps, each[order]]))
    begins = np.concatenate([[0], np.cumsum(df)])
    offsets = np.concatenate([[0, len(head)], len(head) + at[2 * begins[1:]]]).astype(np.int32)
    postings = pa.BinaryArray.from_buffers(pa.binary(), len(df) + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate([head, body]).tobytes())])
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), _spans(kernel.LOWER[data], starts[first], ends[first])])
    totals = np.concatenate([[each.sum()], np.zeros(len(df), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(df) + 1, shard)), terms, pa.array(np.append(len(order), df)), pa.array(totals), postings], ["shard", "term", "df", "n_terms", "postings"])


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Rows of SCHEMA; write them before they are searched, so that they are made once."""
    common.ship(docs.sparkSession)

    def run(batches):
        task = TaskContext.get()
        shard = (task.partitionId() if task else 0) << 32
        ids, parts, size, terms = [], [], 0, 0
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(1)):
                starts, ends, doc, h = kernel.word_hashes(data, offsets, kernel.ALNUM)
                parts.append((data.copy(), starts + size, ends + size, doc + len(ids), h))
                ids += batch.column(0).slice(a, b - a).to_pylist()
                size, terms = size + len(data), terms + len(h)
                if terms >= shard_terms or size >= 1 << 30:
                    if (rows := _rows(shard, ids, parts)) is not None:
                        yield rows
                    ids, parts, size, terms, shard = [], [], 0, 0, shard + 1
        if parts and (rows := _rows(shard, ids, parts)) is not None:
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, SCHEMA)


def best(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, -document) of lists of (ascending documents, gains, greatest gain), documents with score 0 left out.

    Document at a time: heads holds a cursor for each list that can still lift a document among the best by itself.
    """
    lists = sorted(lists, key=lambda x: x[2])
    n, reach = len(lists), list(accumulate(x[2] for x in lists))  # reach: what the lists up to this one can add
    at, found, least, first = [0] * n, [], 0, 0
    while first < n and reach[first] <= least:
        first += 1
    heads = [lists[s][0][0] * n + s for s in range(first, n)]
    heapify(heads)
    while heads:
        doc, score = heads[0] // n, 0
        end = (doc + 1) * n
        while heads and heads[0] < end:
            s = heads[0] % n
            docs, gains, _ = lists[s]
            p = at[s]
            score += gains[p]
            at[s] = p = p + 1
            if p < len(docs):
                heapreplace(heads, docs[p] * n + s)
            else:
                heappop(heads)
        s = first - 1
        while s >= 0 and score + reach[s] > least:
            docs, gains, _ = lists[s]
            at[s] = p = bisect_left(docs, doc, at[s])
            if p < len(docs) and docs[p] == doc:
                score += gains[p]
            s -= 1
        if s < 0 and score > least:  # an equal score has a smaller document already
            if len(found) < k:
                heappush(found, (score, -doc))
            else:
                heapreplace(found, (score, -doc))
            if len(found) == k:
                least, before = found[0][0], first
                while first < n and reach[first] <= least:
                    first += 1
                if first > before:
                    heads = [x for x in heads if x % n >= first]
                    heapify(heads)
    return found


class Shard:
    """The posting lists of a shard that some queries need, decoded: numbers of documents and gains of each."""

    def __init__(self, head: bytes, n_docs: int, postings: pa.Array, df: np.ndarray, weights: np.ndarray, total: tuple[int, int]):
        own = unpacked(np.frombuffer(head, np.uint8))
        known = int(own[0])
        gaps = own[1 : known + 1]
        if known:
            gaps[0] = gaps[0] >> 1 ^ -(gaps[0] & 1)
        self.ids: list = [*np.cumsum(gaps).tolist(), *[None] * (n_docs - known)]
        n, length = total
        m = 25 + 75 * own[known + 1 :] * n // length
        offsets = np.frombuffer(postings.buffers()[1], np.int32)[postings.offset : postings.offset + len(postings) + 1]
        values = unpacked(np.frombuffer(postings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]) if len(df) else np.empty(0, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(df)])
        total_gap = np.cumsum(values[::2])
        before = np.append(0, total_gap)[self.begin[:-1]]
        self.docs, tf = total_gap - np.repeat(before, df), values[1::2]
        self.gains = np.repeat(weights, df) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        self.most = np.maximum.reduceat(self.gains, self.begin[:-1]).tolist() if len(df) else []
        self.kept: dict[int, tuple[list[int], list[int]]] = {}

    def list_of(self, row: int, times: int) -> tuple[list[int], list[int], int]:
        if row not in self.kept:
            a, b = self.begin[row], self.begin[row + 1]
            self.kept[row] = self.docs[a:b].tolist(), self.gains[a:b].tolist()
        docs, gains = self.kept[row]
        return docs, gains if times == 1 else [times * x for x in gains], times * self.most[row]


_FOUND = pa.schema([("query", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _answers(k: int, total: tuple[int, int]):
    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables)).combine_chunks()
        lists = table.filter(pa.compute.is_valid(table["weight"]))
        head = table.filter(pa.compute.is_null(table["weight"]))
        postings = lists["postings"].combine_chunks() if len(lists) else pa.array([], pa.binary())
        postings = postings.chunk(0) if isinstance(postings, pa.ChunkedArray) else postings
        shard = Shard(head["postings"][0].as_py(), head["df"][0].as_py(), postings, lists["df"].to_numpy(), lists["weight"].to_numpy(), total)
        queries: dict[tuple, list[tuple[int, int]]] = {}
        for row, uses in enumerate(lists["uses"]):
            for x in uses.as_py():
                queries.setdefault((x["query"], x["item_id"]), []).append((row, x["times"]))
        rows = []
        for query, terms in queries.items():
            rows += [(*query, shard.ids[-doc], score) for score, doc in best([shard.list_of(*x) for x in terms], k)]
        yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, x, strict=True)) for x in rows], _FOUND)

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """query, item_id, term, times of the distinct rows of items."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("query"), "item_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    return rows.groupBy("query", "item_id", "term").agg(F.count("*").alias("times"))


def search(postings: DataFrame, items: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query, item_id, rank, doc_id, score: the k best documents of each query."""
    spark = postings.sparkSession
    common.ship(spark)
    heads, lists = postings.filter("term IS NULL"), postings.filter("term IS NOT NULL")
    n, length = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = common.written(query_terms(items), "query-terms")
    size, n_queries = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)), F.count_distinct("query")).first()
    blocks, small = max(1, -(-n_queries // query_block)), F.broadcast if size <= broadcast_bytes else lambda table: table
    df = lists.select("term", "df").join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("all") + 1))).cast("long")
    uses = terms.groupBy("term", F.pmod("query", F.lit(blocks).cast("long")).alias("block")).agg(F.collect_list(F.struct("query", "item_id", "times")).alias("uses"))
    wanted = uses.join(df, "term").select("term", "block", weight.alias("weight"), "uses")
    needed = lists.join(small(wanted), "term").select("shard", "block", "df", "weight", "uses", "postings")
    own = heads.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "df", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(needed.schema["uses"].dataType).alias("uses"), "postings")
    found = needed.unionByName(own).groupBy("shard", "block").applyInArrow(_answers(k, (n, length)), "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query", "item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = common.written(index(common.read(spark, sf_dir, "documents")), "postings")
    return search(postings, common.read(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
asked AS (SELECT item_id, text, t, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS}) AS t FROM items) GROUP BY ALL),
n AS (SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
gain AS (SELECT r, t, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * c) // l))) AS g FROM tf JOIN n USING (r) JOIN weight USING (t), total),
scored AS (SELECT item_id, text, r, doc_id, sum(times * g)::BIGINT AS score FROM asked JOIN gain USING (t) GROUP BY ALL)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}
"""

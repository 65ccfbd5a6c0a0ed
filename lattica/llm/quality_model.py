"""Quality classifier by nearest-neighbour voting (operator 8).

A document is a bag of hashed terms of three kinds: lower-cased words, shapes of white-space tokens (runs
of capitals, small letters and digits shortened to one sign, other characters as they are) and a few
statistics put into steps. TF-IDF weights, scaled to one length for each kind, are projected to latent
semantic vectors by a truncated SVD. At most FIT_ROWS labelled documents, those whose ids have the least
hashes, are vectors with labels that every task gets: a table of fixed size. Each document's cosine with
all of them is computed exactly, in blocks; the NEIGHBOURS nearest vote, weighted by similarity.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Scores use the text alone.

Defined results: null and empty texts have no terms and get the share of label 1 among the labelled; with
no usable label every score is 0.5; ids labelled more than once count as 1 if any label says so; repeated rows are scored each;
an empty table gives an empty table; scored() passes extra columns on, and takes a free name for its own. Of documents
that are equally near, those with the least ids vote. Texts of any length are read whole; memory follows one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

FIT_ROWS, RANK, NEIGHBOURS, POWER = 4096, 48, 25, 4.0
WORD_TERMS, SHAPE_TERMS, STAT_TERMS = 1 << 12, 1 << 10, 1 << 8
TERMS = WORD_TERMS + SHAPE_TERMS + STAT_TERMS
BLOCK = 512
_KINDS = [(0, WORD_TERMS, 1.0), (WORD_TERMS, WORD_TERMS + SHAPE_TERMS, 1.0), (WORD_TERMS + SHAPE_TERMS, TERMS, 1.0)]

_SHAPE = kernel.SAME.copy()
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _term(h: np.ndarray, size: int) -> np.ndarray:
    return (h % np.uint64(size)).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight before IDF) of the distinct terms of each document of a chunk."""
    n = len(offsets) - 1
    _, _, doc, words = kernel.word_hashes(data, offsets, kernel.ALNUM)
    starts, ends, own = kernel.runs(kernel.NOT_SPACE[data], offsets)
    shape = _SHAPE[data]
    keep = np.append(True, shape[1:] != shape[:-1]) if len(data) else np.empty(0, bool)
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = kernel.span_hash(kernel.prefix_hash(shape[keep]), at[starts], at[ends]) if len(starts) else np.empty(0, np.uint64)
    key = np.concatenate([doc * TERMS + _term(words, WORD_TERMS), own * TERMS + WORD_TERMS + _term(shapes, SHAPE_TERMS)])
    pairs, times = np.unique(key, return_counts=True)
    # Statistics in steps: share of distinct words, of capitals, of signs, length, words a line, repeats of the word before.
    total = np.maximum(kernel.counts(doc, n), 1)
    first = np.unique(kernel.mix(words ^ kernel.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    distinct = kernel.counts(doc[first], n)
    again = kernel.counts(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], n) if len(words) > 1 else np.zeros(n, np.int64)
    sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    capitals, signs, lines = sums((data >= 65) & (data <= 90)), sums(~kernel.ALNUM[data] & ~kernel.SPACE[data]), sums(data == 10)
    steps = [
        np.minimum(10 * distinct // np.maximum(total, 1) * 3, 30) // 3 + 11 * (total > 200),
        np.minimum(10 * capitals // size, 9),
        np.minimum(40 * signs // size, 15),
        np.minimum(np.log2(total).astype(np.int64), 15),
        np.minimum(np.log2(total // (lines + 1) + 1).astype(np.int64), 15),
        np.minimum(10 * again // total, 10),
    ]
    some = np.flatnonzero(np.diff(offsets) > 0)
    doc_out, term_out, weight_out = [pairs // TERMS], [pairs % TERMS], [1 + np.log(times)]
    for k, step in enumerate(steps):
        doc_out.append(some)
        term_out.append(WORD_TERMS + SHAPE_TERMS + 32 * k + step[some])
        weight_out.append(np.ones(len(some)))
    d, t, w = map(np.concatenate, (doc_out, term_out, weight_out))
    order = np.argsort(d, kind="stable")
    return d[order], t[order], w[order].astype(np.float32)


def _weighted(doc, term, weight, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each kind of a document's terms scaled to one length."""
    w = weight * idf[term]
    for a, b, scale in _KINDS:
        own = (term >= a) & (term < b)
        norm = np.sqrt(np.bincount(doc[own], w[own] ** 2, minlength=n))
        w[own] *= scale / np.maximum(norm, 1e-9)[doc[own]]
    return w.astype(np.float32)


def nearest(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; of those that tie at the last place the first ones."""
    m = similar.shape[1]
    if k >= m:
        return np.broadcast_to(np.arange(m), similar.shape)
    top = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(similar, top, 1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((similar >= last).sum(axis=1) > k):
        above, ties = np.flatnonzero(similar[row] > last[row]), np.flatnonzero(similar[row] == last[row])
        top[row] = np.concatenate([above, ties[: k - len(above)]])
    return top


class Model:
    """IDF, projection, and the labelled vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        n = len(rows)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 0.5
        if not n:
            return
        doc = np.repeat(np.arange(n), [len(t) for t, _ in rows])
        term, weight = np.concatenate([t for t, _ in rows]).astype(np.int64), np.concatenate([w for _, w in rows])
        self.idf = np.log((1 + n) / (1 + np.bincount(term, minlength=TERMS))).astype(np.float32) + np.float32(0.1)
        table = np.zeros((n, TERMS), np.float32)
        table[doc, term] = _weighted(doc, term, weight, n, self.idf)
        rank = min(RANK, n)
        rng = np.random.default_rng(8)
        q = np.linalg.qr(table.T @ rng.standard_normal((n, rank + 16), np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(table.T @ (table @ q))[0]
        _, _, vt = np.linalg.svd(table @ q, full_matrices=False)
        self.projection = np.ascontiguousarray((q @ vt.T)[:, :rank], np.float32)
        self.vectors = self._unit(table @ self.projection)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.prior)
        if not len(self.labels):
            return out
        doc, term, weight = terms(data, offsets)
        w = _weighted(doc, term, weight, n, self.idf)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            own = slice(bounds[a], bounds[b])
            dense = np.zeros((b - a, TERMS), np.float32)
            dense[doc[own] - a, term[own]] = w[own]
            some = bounds[a + 1 : b + 1] > bounds[a:b]
            near = self._unit(dense @ self.projection) @ self.vectors.T
            top = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, top, 1), 0) ** POWER + 1e-6
            score = (vote * self.labels[top]).sum(axis=1) / vote.sum(axis=1)
            out[a:b] = np.where(some, score, self.prior)
        return np.clip(out, 0.0, 1.0)


def _featurise(batches):
    for batch in batches:
        for a, b, data, offsets in kernel.chunks(batch.column(2)):
            doc, term, weight = terms(data, offsets)
            at = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(weight))], ["doc_id", "quality", "terms", "weights"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, target: str = "quality") -> Model:
    """Learns from at most fit_rows documents of the folds allowed; only their term weights reach the driver."""
    common.ship(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~common.held_out("doc_id", 3, 1)).groupBy(key.alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("quality"))
    # Ids of documents that exist, before the sample is bounded; only ids are read here.
    chosen = chosen.join(docs.select(key.alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # At most fit_rows ids; of a chosen id's rows one is kept, the one whose text has the least hash, before anything reaches the driver.
    texts = docs.select(key.alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    got = texts.mapInArrow(_featurise, "doc_id long, quality int, terms array<int>, weights array<float>").toArrow().sort_by("doc_id")
    term, weight = got.column("terms").combine_chunks(), got.column("weights").combine_chunks()
    return Model([(np.array(t.values), np.array(w.values)) for t, w in zip(term, weight, strict=True)], np.array(got.column("quality").to_pylist(), np.float32))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with one more column, the score of the text; where docs has a column of that name, the new one gets underscores in front."""
    spark = docs.sparkSession
    score = common.free_name(docs.columns, score)
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(data, offsets), pa.float64())], [*part.schema.names, score])

    return common.map_rows(docs, run, [T.StructField(score, T.DoubleType())])


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    score = common.free_name(docs.columns, "quality_score")
    return scored(docs, fit(docs, labels), score).filter(F.col(score) >= threshold).drop(score)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, common.read(spark, sf_dir, "labels")))
    return out.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Token counts from distinct pre-tokens (operator 6).

A pre-token is a run of spaces with the characters after it, or a line feed with those after it. No piece
of the model joins characters across such a border (checked when the model is loaded), so a text has as
many tokens as its pre-tokens have. Each distinct pre-token of the corpus is counted once; frequencies of
each document are joined to these counts and summed; ids are never made.

The HEAD most frequent pre-tokens, a table of fixed size, go to every task; a document's other pre-tokens
are joined by shuffle, and none of those is frequent enough to be a hot key.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty
table gives an empty table; extra columns are not read.
A null doc_id is passed on. A text of any length is counted whole, piece by piece of its pre-tokens; a task's memory
follows the longest text.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel, tokens

HEAD = 200_000
FLUSH = 400_000  # distinct pre-tokens that a task holds before it passes them on
_SPLIT = re.compile(r" +[^ \n]*|\n[^ \n]*")
_MARK = "▁"
_MODELS: dict = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if re.search(f"[^{_MARK}]{_MARK}|\n", piece):
                raise ValueError(f"piece {piece!r} joins text across pre-tokens")
        _MODELS[path] = sp
    return _MODELS[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text with the model's leading space; joined they give the text back."""
    return _SPLIT.findall(" " + text.replace(_MARK, " ")) if text else []


def pieces(sp, words: list[str]) -> list[int]:
    """Number of pieces of each pre-token. The library puts a space before what it encodes."""
    got = sp.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
    return [1 if w == " " else len(ids) - (w[0] == "\n") for w, ids in zip(words, got, strict=True)]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, freq of every distinct pre-token of all texts."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "freq"])

        for batch in batches:
            for a, b, *_ in kernel.chunks(batch.column(0)):
                seen.update(chain.from_iterable(map(pre_tokens, batch.column(0).slice(a, b - a).to_pylist())))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(common.text_of().alias("text")).mapInArrow(count, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def counted(words: DataFrame, path: str) -> DataFrame:
    """Adds n_pieces to rows of word, freq."""

    def count(batches):
        sp = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces(sp, batch.column(0).to_pylist()), pa.int64())], ["word", "freq", "n_pieces"])

    return words.mapInArrow(count, "word string, freq long, n_pieces long")


def token_counts(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    table = common.written(counted(vocabulary(docs), path), "pieces")
    top = table.orderBy(F.desc("freq"), "word").limit(head).select("word", "n_pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def frequencies(batches):
        get = known.value.get
        for batch in batches:
            for a, b, _, at in kernel.chunks(batch.column(2)):
                rows = batch.slice(a, b - a)
                keys = rows.column(0).to_pylist()
                words = list(map(pre_tokens, rows.column(2).to_pylist()))
                doc = np.repeat(np.arange(b - a), np.fromiter(map(len, words), np.int64, len(words)))
                flat = list(chain.from_iterable(words))
                n = np.array(list(map(get, flat, repeat(-1))), np.int64)
                sums = kernel.counts(doc[n >= 0], b - a, n[n >= 0])
                rare = Counter((int(doc[i]), flat[i]) for i in np.flatnonzero(n < 0).tolist())
                owner = [k for k, _ in rare]
                ids = rows.column(1)
                # A document's own row has a key that no pre-token has, another one each, so that these spread out.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*keys, *(keys[k] for k in owner)], pa.int64()),
                        pa.concat_arrays([ids, ids.take(pa.array(owner, pa.int64()))]),
                        pa.array([*(f"={k}" for k in keys), *(w for _, w in rare)], pa.string()),
                        pa.array(np.concatenate([sums, np.fromiter(rare.values(), np.int64, len(rare))])),
                        pa.array(np.concatenate([np.diff(at), np.zeros(len(rare), np.int64)])),
                    ],
                    ["row", "doc_id", "word", "freq", "n_bytes"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    per_doc = rows.mapInArrow(frequencies, "row long, doc_id long, word string, freq long, n_bytes long")
    joined = per_doc.join(table.select("word", "n_pieces"), "word", "left")
    return joined.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("freq") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens")).drop("row")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(common.read(spark, sf_dir, "documents"), tokens.public("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)

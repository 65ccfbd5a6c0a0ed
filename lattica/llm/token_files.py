"""Token ids as Parquet list columns (operator 4).

A file holds rows in ascending doc_id order: doc_id, shard, shard_start (ids before the row in its
shard), n_tokens, tokens. Ids are dictionary encoded, row groups and pages are kept small and Parquet's
page indexes are written, so a reader that wants some documents or only the counts skips the rest.

Defined results: null text encodes as empty (just the end id); equal doc_ids are ordered by a hash of
the text; null doc_ids come first; an empty table gives an empty table; other columns are not read. A text of any length is one
row, encoded whole, so a task's memory follows the longest text. The query's files go when the driver's process ends.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernel, tokens

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, tokens array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS, DICTIONARY_BYTES = 16 << 20, 256 << 10, 1000, 1 << 20


def encoded(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Rows of SCHEMA, range-partitioned and sorted by doc_id; a partition is a shard."""
    spark = docs.sparkSession
    common.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        task = TaskContext.get()
        shard, start = task.partitionId() if task else 0, 0
        enc = tokens.encoder(path)
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, at = tokens.with_end(*enc.encode(data, offsets), end_id)
                each = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(b - a, shard, np.int32)), pa.array(start + at[:-1]), pa.array(each), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    ["doc_id", "shard", "shard_start", "n_tokens", "tokens"],
                )
                start += int(at[-1])

    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    return rows.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2) -> None:
    encoded(docs, path, end_id).write.options(
        **{"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": DICTIONARY_BYTES, "parquet.column.index.truncate.length": 64}
    ).parquet(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids, a filter that row group statistics and page indexes serve."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and shard; the ids themselves are not read."""
    rows = read_tokens(spark, out).select("doc_id", "shard", "shard_start", "n_tokens")
    return rows.join(shard_bases(rows), "shard").select("doc_id", "shard", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens")


def shard_bases(rows: DataFrame) -> DataFrame:
    """shard, shard_base: one row a shard, so the window over all of them is small."""
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_base"))


def checksums(batches):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        ids = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.uint32)
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.new_path(spark, "tokens")
    write_tokens(common.read(spark, sf_dir, "documents"), out, tokens.public("byte_bpe_50k.json"))
    common.deleted_at_exit(spark, out)
    rows = read_tokens(spark, out)
    digests = rows.mapInArrow(checksums, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return digests.join(shard_bases(rows), "shard").select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")

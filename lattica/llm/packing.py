"""Bounded-space online packing of token ids into windows (operator 10).

Each partition keeps OPEN windows. A document of a window or more fills whole windows first; the rest
goes, uncut, into the open window that it fills best (least room left). Where none has room, the fullest
window is closed and a new one opened. At the end of its partition every window still open is a leftover;
leftovers are merged by a second run of the same packing over few partitions, this time cutting pieces so
that a window is filled to the last id. A window of fewer ids is padded to SIZE unless its length is a
power of two.

Defined results: null text is a document of the end id only; repeated rows are packed as often as they
come; an empty table gives an empty table; extra columns are not read.
A null doc_id is passed on, and its pieces are placed like any other's. A text of any length is encoded whole and cut
into windows; a task's memory follows the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel, tokens

SIZE, OPEN = 4096, 32
PIECE = "doc_id long, start long, length long, doc_tokens long, offset long"
SCHEMA = f"closed boolean, part int, seq int, used int, {PIECE}, ids array<int>"
_NAMES = ["closed", "part", "seq", "used", "doc_id", "start", "length", "doc_tokens", "offset", "ids"]
LEFTOVERS_A_TASK = 2_000


class Packer:
    """Windows of one partition. Pieces are (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, n_open: int, cut: bool):
        self.size, self.n_open, self.cut, self.seq = size, n_open, cut, 0
        self.open: list[list] = []  # [used, pieces]
        self.done: list[tuple[bool, int, list]] = []

    def close(self, window: list, closed: bool = True) -> None:
        self.done.append((closed, window[0], window[1]))

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self.close([self.size, [(doc, start, total, ids[: self.size])]])
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            fits = [w for w in self.open if self.size - w[0] >= len(ids)]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.n_open and not self.cut:
                self.open.append(best := [0, []])
            elif self.cut and self.open:
                best = max(self.open, key=lambda w: w[0])
            else:
                if self.open:
                    fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
                    self.close(self.open.pop(fullest))
                self.open.append(best := [0, []])
            room = self.size - best[0]
            best[1].append((doc, start, total, ids[:room]))
            best[0] += min(room, len(ids))
            ids, start = ids[room:], start + room
            if best[0] == self.size:
                self.open = [w for w in self.open if w is not best]
                self.close(best)

    def drain(self, part: int) -> pa.RecordBatch | None:
        """The windows ended so far, a row for each piece."""
        rows, self_done = [], self.done
        self.done = []
        ids = []
        for closed, used, pieces in self_done:
            offset = 0
            for doc, start, total, own in pieces:
                rows.append((closed, part, self.seq, used, doc, start, len(own), total, offset))
                offset += len(own)
                ids.append(own)
            self.seq += 1
        if not rows:
            return None
        types = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)), lists], _NAMES)


def _task() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = SIZE, n_open: int = OPEN) -> DataFrame:
    """Rows of pieces with their ids: sequence_id, offset, doc_id, start, length, doc_tokens, used, padded, ids."""
    spark = docs.sparkSession
    common.ship(spark)

    def first(batches) -> Iterator[pa.RecordBatch]:
        enc, packer, part = tokens.encoder(path), Packer(size, n_open, cut=False), _task()
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(1)):
                rows = batch.slice(a, b - a)
                ids, at = tokens.with_end(*enc.encode(data, offsets), end_id)
                for k, doc in enumerate(rows.column(0).to_pylist()):
                    packer.add(doc, 0, int(at[k + 1] - at[k]), ids[at[k] : at[k + 1]])
                for w in packer.open:  # an open window must not hold the whole chunk's ids in memory
                    w[1] = [(d, s, t, x if x.base is None else x.copy()) for d, s, t, x in w[1]]
                if (out := packer.drain(part)) is not None:
                    yield out
        for w in packer.open:
            packer.close(w, closed=False)
        if (out := packer.drain(part)) is not None:
            yield out

    def second(batches) -> Iterator[pa.RecordBatch]:
        packer, part = Packer(size, 1, cut=True), _task()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "doc_tokens")]
            lists = batch.column(batch.schema.get_field_index("ids"))
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for doc, start, total, a, b in zip(*columns, at[:-1], at[1:], strict=True):
                packer.add(doc, start, total, ids[a:b].copy())
            if (out := packer.drain(part)) is not None:
                yield out
        for w in packer.open:
            packer.close(w)
        if (out := packer.drain(part)) is not None:
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    packed = common.written(rows.mapInArrow(first, SCHEMA), "packed")
    left = packed.filter(~F.col("closed"))
    n_left = packed.filter(~F.col("closed")).groupBy("part", "seq").count().count()
    n = max(1, n_left // LEFTOVERS_A_TASK)
    # A leftover's pieces stay together; whole leftovers are dealt by partition number, so no key is hot.
    left = left.repartition(n, "part", "seq").sortWithinPartitions("part", "seq", "offset")
    merged = common.written(left.mapInArrow(second, SCHEMA), "merged")
    # Part numbers stay below 2^23 and sequence numbers below 2^31; merged windows have odd ids.
    name = lambda odd: (F.col("part").cast("long") * F.lit(1 << 32) + F.col("seq").cast("long") * 2 + odd).alias("sequence_id")
    padded = F.when(F.expr("bit_count(used) = 1"), F.col("used")).otherwise(F.lit(size)).alias("padded")
    columns = ["offset", "doc_id", "start", "length", "doc_tokens", "used", padded, "ids"]
    return packed.filter("closed").select(name(0), *columns).unionByName(merged.select(name(1), *columns))


def _crc(batches):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ids, at = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.uint32), lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [k for k, f in enumerate(batch.schema.names) if f != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(crc, pa.int64())], [*(batch.schema.names[k] for k in keep), "ids_crc32"])


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_crc, "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, used int, padded int, ids_crc32 long").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used", "padded"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.read(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json")))

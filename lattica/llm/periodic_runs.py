"""Periodic runs of words (operator 11).

A run is a stretch of words with smallest period q that no neighbouring word extends. By the runs theorem each run holds,
under the order of words or under the reversed one, the longest Lyndon word that begins at some place and is as long
as the period. So each text is scanned once from right to left under both orders; the stack of Lyndon words is the
chain of their ends. Words of the stack that begin alike are compared, and roots are extended to the left and to
the right, by binary searches over rolling hashes for the longest common extension. What hashes find is verified
word by word; where a hash was wrong, words alone decide. Words are numbered by their bytes, so equal numbers are equal words.

Defined results: null text reads as empty; empty texts have no runs; words are kept in order and joined by one space; repeated
rows and rows with null ids are taken each by itself; an empty table gives an empty table; extra columns, whatever their names, are
passed on. A text is scanned by one task in time that follows its length, a chunk of texts or one longer text at once.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

MIN_LENGTH, MIN_EXPONENT = 6, 4
_MASK = (1 << 64) - 1


class Scan:
    """The runs in a row of word numbers in which -1 parts texts and stands at the end."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.order = symbols, symbols.tolist()
        self.power, _ = kernel._powers(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(kernel.mix(symbols.astype(np.uint64)) * self.power[:-1], out=self.prefix[1:])
        self._sums, self._powers = memoryview(self.prefix), memoryview(self.power)

    def common(self, a: int, b: int, most: int) -> int:
        """How many words, up to most, are the same from a and from b (> a) on, where the first words are."""
        words, sums = self.order, self._sums
        if most == 1 or words[a + 1] != words[b + 1]:
            return 1
        shift, at_a, at_b, low, high = self._powers[b - a], sums[a], sums[b], 2, most
        while low < high:
            mid = (low + high + 1) >> 1
            if ((sums[a + mid] - at_a) * shift - sums[b + mid] + at_b) & _MASK:
                high = mid - 1
            else:
                low = mid
        if words[a : a + low] != words[b : b + low]:  # two hashes were equal by chance
            low = next(k for k in range(low) if words[a + k] != words[b + k])
        return low

    def lyndon(self) -> np.ndarray:
        """The end of the longest Lyndon word from each place, under the order of self.order."""
        words, common = self.order, self.common
        end = [0] * len(words)
        for i in range(len(words) - 1, -1, -1):
            first, j = words[i], i + 1
            if first >= 0:
                y = words[j]
                while first <= y:
                    if first == y:
                        left, right = j - i, end[j] - j
                        most = left if left < right else right
                        same = common(i, j, most)
                        if left >= right if same == most else words[i + same] > words[j + same]:
                            break
                    j = end[j]
                    y = words[j]
            end[i] = j
        return np.array(end, np.int64)

    def _reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words are the same from a and b (> a) on, or before them."""
        low, high, sums, shift = np.zeros(len(a), np.int64), most.copy(), self.prefix, self.power[b - a]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (sums[a] - sums[a - mid]) * shift == sums[b] - sums[b - mid] if back else (sums[a + mid] - sums[a]) * shift == sums[b + mid] - sums[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def runs(self, first: np.ndarray, last: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
        """(start, end, period) of the runs, sorted; first, last: where the text of each place begins and ends."""
        symbols, found = self.symbols, []
        for reverse in (False, True):
            if reverse:
                self.order = np.where(symbols < 0, -1, int(symbols.max(initial=0)) - symbols).tolist()
            root = np.flatnonzero(symbols >= 0)
            period = self.lyndon()[root] - root
            # The first root of a run of such an exponent has that many periods, less one, after it.
            for k in range(1, min_exponent - 1):
                good = root + k * period < last[root]
                good[good] = symbols[root[good]] == symbols[root[good] + k * period[good]]
                root, period = root[good], period[good]
            right = self._reach(root, root + period, last[root] - root - period, False)
            left = self._reach(root, root + period, root - first[root], True)
            found.append(np.stack([root - left, root + period + right, period, root], axis=1))
        out = np.concatenate(found)
        out = out[out[:, 1] - out[:, 0] >= np.maximum(min_length, min_exponent * out[:, 2])]
        runs, group = np.unique(out[:, :3], axis=0, return_inverse=True) if len(out) else (out[:, :3], out[:, 3])
        exact = set()
        for k, (start, end, period) in enumerate(runs.tolist()):
            if self._holds(start, end, period, first, last):
                exact.add((start, end, period))
            else:  # hashes were equal by chance: each root is extended by its words
                exact.update(self._extended(x, period, first, last) for x in out[group == k, 3].tolist())
        out = np.array(sorted(exact), np.int64).reshape(-1, 3)
        return out[out[:, 1] - out[:, 0] >= np.maximum(min_length, min_exponent * out[:, 2])]

    def _holds(self, start: int, end: int, period: int, first: np.ndarray, last: np.ndarray) -> bool:
        """Whether the words repeat so, and the words beside do not."""
        s = self.symbols
        whole = (start == first[start] or s[start - 1] != s[start - 1 + period]) and (end == last[start] or s[end] != s[end - period])
        return bool(whole) and np.array_equal(s[start : end - period], s[start + period : end])

    def _extended(self, root: int, period: int, first: np.ndarray, last: np.ndarray) -> tuple[int, int, int]:
        s, start, end = self.symbols, root, root + period
        while start > first[root] and s[start - 1] == s[start - 1 + period]:
            start -= 1
        while end < last[root] and s[end] == s[end - period]:
            end += 1
        return start, end, period


def scan(words: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs as start, length, period by start and period; how many of each text; which words of all texts stay) of some texts."""
    number: dict[bytes, int] = {}
    for own in words:
        number.update(dict.fromkeys(own))
    for k, w in enumerate(number):
        number[w] = k
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(size + 1) - size - 1
    symbols = np.full(int((size + 1).sum()), -1, np.int64)
    for a, n, own in zip(at.tolist(), size.tolist(), words, strict=True):
        symbols[a : a + n] = np.fromiter(map(number.__getitem__, own), np.int64, n)
    text = np.repeat(np.arange(len(words)), size + 1)
    runs = Scan(symbols).runs(at[text], (at + size)[text], min_length, min_exponent)
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    keep = (np.cumsum(cover[:-1]) == 0)[symbols >= 0]
    own = text[runs[:, 0]]
    return np.stack([runs[:, 0] - at[own], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1), kernel.counts(own, len(words)), keep


_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def collapsed(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, runs: str = "runs") -> DataFrame:
    """docs whose texts keep of each run its first period alone, and the runs in a column of the given name (of a free one, if taken)."""
    common.ship(docs.sparkSession)
    at, kind = docs.columns.index("text"), docs.schema["text"].dataType

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(at)):
                body, bounds = data.tobytes(), offsets.tolist()
                words = [body[x:y].split() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                found, each, keep = scan(words, min_length, min_exponent)
                ends = np.cumsum([len(x) for x in words])
                texts = []
                for own, e, n in zip(words, ends.tolist(), each.tolist(), strict=True):
                    texts.append(b" ".join(compress(own, keep[e - len(own) : e].tolist()) if n else own))
                part = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found.T], ["start", "length", "period"])
                )
                text = pa.array(texts, pa.binary()).cast(part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*(text if k == at else c for k, c in enumerate(part.columns)), lists], [*part.schema.names, "runs"])

    if not isinstance(kind, T.StringType):
        raise TypeError(f"text must be a string, not {kind.simpleString()}")
    return common.map_rows(docs, run, [T.StructField(common.free_name(docs.columns, runs), _RUNS)])


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns of collapsed()'s rows: the longest run, and the digests of all runs and of the text."""
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs; where crc32(doc_id) ends in 0, the words from some place on repeat the first few of them, by the contract's rule."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, h in enumerate(batch.column(2).to_pylist()):
                words = texts[k].encode().split() if h is not None and h % 10 == 0 else ()
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.schema.field(1).type)], ["doc_id", "text"])

    key = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), key.alias("h")).mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(collapsed(looped(common.read(spark, sf_dir, "documents"))))

"""Vectorised text kernels over the UTF-8 bytes of Arrow string columns (numpy; no per-word Python objects).

Word classes of the contracts are decided by single bytes: every byte of a multi-byte character is a
word byte, so words of whole texts are runs in a byte mask. Hashes are 64-bit polynomials of the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once; a longer text is a chunk of its own

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)
SPACE = (_ALL == 0x20) | ((_ALL >= 9) & (_ALL <= 0x0D))
NOT_SPACE = ~SPACE
ALNUM = (_ALL >= 0x80) | ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122))

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _P), ("q", _PINV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["p"][:n], _POWERS["q"][:n]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Gives memory that is no longer used back to the system; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a permutation of uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def as_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        return column
    return column.cast(pa.large_string())


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most limit bytes; null reads as empty."""
    column = as_array(column)
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    release()


def runs(mask: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document of each) of the runs of True; no run crosses a document's border, nor any of cuts (True: before this byte)."""
    n = len(mask)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    if cuts is not None:
        first |= cuts & mask
        last[:-1] |= cuts[1:] & mask[:-1]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = mask[a]
    last[b] = mask[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hash(data: np.ndarray, lut: np.ndarray = SAME) -> np.ndarray:
    """Sums of (byte + 1) * P^position before each position; span_hash takes hashes of spans from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    p, _ = _powers(len(data) + 1)
    np.cumsum((lut[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * q[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lut: np.ndarray = LOWER):
    """(starts, ends, document, hash) of the words of a chunk."""
    starts, ends, doc = runs(word[data], offsets)
    return starts, ends, doc, span_hash(prefix_hash(data, lut), starts, ends) if len(starts) else np.empty(0, np.uint64)


def text_hashes(texts: list[str], word: np.ndarray = ALNUM, lut: np.ndarray = LOWER) -> list[np.ndarray]:
    """Hashes of the words of each of some short texts."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in chunks(pa.array(texts, pa.large_string())):
        _, _, doc, h = word_hashes(data, offsets, word, lut)
        out += np.split(h, np.searchsorted(doc, np.arange(1, b - a)))
    return out


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n consecutive words of one document."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g *= np.uint64(_P)
        g += h[i : i + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(g[at])


def counts(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)

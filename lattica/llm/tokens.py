"""Ids of whole texts by the tokenizers library, with a bounded cache of segments.

A tokenizer whose pre-tokenizer never joins text across white space, nor an ASCII letter to a sign after
it, gives a text the ids of its segments; each distinct segment is encoded by the library once while a
worker's cache holds it, and found again by a 64-bit hash of its bytes. Texts with white space beyond
ASCII, with control characters on which regular expression libraries disagree, or with a special token's
string are encoded whole by the library.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernel

MAX_CACHED = 400_000  # segments held by a worker; those met once go first
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_SIGN = (np.arange(256) > 32) & (np.arange(256) < 127) & ~kernel.ALNUM
_CONTROL = np.isin(np.arange(256), range(0x1C, 0x20))
_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE = np.array(sorted({int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}))
#: Byte-level models read bytes as signs: printable Latin-1 as it is, the others from U+0100 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_documents(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Documents that the cache can't serve."""
    at = [np.flatnonzero(_CONTROL[data])]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        padded = np.append(data, [0, 0])
        two = (data[lead].astype(np.int64) << 16) | (padded[lead + 1].astype(np.int64) << 8)
        at.append(lead[np.isin(np.where(data[lead] == 0xC2, two, two | padded[lead + 2]), _WIDE)])
    body = data.tobytes()
    for x in special:
        k = body.find(x)
        while k >= 0:
            at.append(np.array([k]))
            k = body.find(x, k + 1)
    return np.unique(np.searchsorted(offsets, np.concatenate(at), side="right") - 1)


class CachedEncoder:
    def __init__(self, path: str, limit: int = MAX_CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or ()]
        self.mode, self.limit = self._mode(spec), limit
        self._clear()

    @staticmethod
    def _mode(spec: dict) -> str:
        """byte: a space belongs to the segment after it; word: white space is dropped; whole: no segments."""
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
            return "byte"
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}:
            parts = before.get("pretokenizers", [{}])
            if parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
                return "word"
        return "whole"

    # The cache: entry k has hash key[k] and ids flat[start[k] : start[k] + size[k]]; slots is an open hash table of entries.

    def _clear(self) -> None:
        self.n = self.used = 0
        self.key, self.flat = np.empty(1 << 12, np.uint64), np.empty(1 << 14, np.int32)
        self.start, self.size, self.hits = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.mask, self.slots = (1 << 13) - 1, np.full(1 << 13, -1, np.int32)

    def _place(self, first: int) -> None:
        """Enters the entries from first on into the hash table."""
        left = np.arange(first, self.n)
        at = (self.key[left] & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + 1) & self.mask

    def _add(self, key: np.ndarray, flat: np.ndarray, size: np.ndarray, hits: np.ndarray) -> None:
        n, used = self.n + len(key), self.used + len(flat)
        grown = lambda x, least: np.concatenate([x, np.zeros(max(len(x), least - len(x)), x.dtype)]) if least > len(x) else x
        self.key, self.start, self.size, self.hits = (grown(x, n) for x in (self.key, self.start, self.size, self.hits))
        self.flat = grown(self.flat, used)
        self.key[self.n : n], self.size[self.n : n], self.hits[self.n : n] = key, size, hits
        self.start[self.n : n] = self.used + np.cumsum(size) - size
        self.flat[self.used : used] = flat
        first, self.n, self.used = self.n, n, used
        if 2 * n > len(self.slots):
            size = 1 << int(2 * n).bit_length()
            self.mask, self.slots, first = size - 1, np.full(size, -1, np.int32), 0
        self._place(first)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, at, want = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64), h
        while len(left):
            entry = self.slots[at]
            good = (entry >= 0) & (self.key[entry] == want)
            out[left[good]] = entry[good]
            more = (entry >= 0) & ~good
            left, at, want = left[more], (at[more] + 1) & self.mask, want[more]
        return out

    def _learn(self, key: np.ndarray, words: list[str]) -> None:
        if self.n + len(key) > self.limit:
            old, flat, size, hits = self.key[: self.n], self.flat[: self.used], self.size[: self.n], self.hits[: self.n]
            keep = hits > 1
            if keep.sum() * 2 > self.limit:
                keep &= hits > np.median(hits[keep])
            self._clear()
            self._add(old[keep], flat[np.repeat(keep, size)], size[keep], hits[keep])
        ids = self._encode_words(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self._add(key, flat, sizes, np.zeros(len(key), np.int32))

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of segments. One of Latin letters alone is a single pre-token, which goes to the library's model at once."""
        out: list[list[int]] = [[]] * len(words)
        rest, tokenize, byte = [], self.tokenizer.model.tokenize, self.mode == "byte"
        for k, w in enumerate(words):
            space = byte and w[0] == " "
            core = w[1:] if space else w if byte else w.lower()
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                if not core.isascii():
                    core = core.encode().decode("latin-1").translate(_BYTE_SIGNS)
                out[k] = [x.id for x in tokenize(_BYTE_SIGNS[32] + core if space else core)]
            else:
                rest.append(k)
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            got = self.tokenizer.encode([words[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            bounds = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            ids = got.ids
            for k, x, y in zip(part, bounds[:-1], bounds[1:], strict=True):
                out[k] = ids[x:y]
        return out

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, document) of the segments; joined they give each document, white space aside in word mode."""
        solid = kernel.NOT_SPACE[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = _LETTER[data[:-1]] & _SIGN[data[1:]]
        starts, ends, doc = kernel.runs(solid, offsets, cuts)
        if self.mode == "word":
            return starts, ends, doc
        # White space: the last character before a word goes to the word if it is a space, else it stands alone; what is before it is one segment.
        a, b, own = kernel.runs(~solid, offsets)
        final = b == offsets[own + 1]
        joins = ~final & (data[np.maximum(b - 1, 0)] == 32)
        starts[np.searchsorted(starts, b[joins])] -= 1
        lone = ~final & ~joins
        more_a = np.concatenate([a, b[lone] - 1])
        more_b = np.concatenate([np.where(final, b, b - 1), b[lone]])
        more_d = np.concatenate([own, own[lone]])
        some = more_b > more_a
        order = np.argsort(more_a[some])
        more_a, more_b, more_d = more_a[some][order], more_b[some][order], more_d[some][order]
        at = np.searchsorted(starts, more_a)
        return np.insert(starts, at, more_a), np.insert(ends, at, more_b), np.insert(doc, at, more_d)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each) of a chunk of texts, as kernel.chunks() gives it."""
        n = len(offsets) - 1
        odd = np.arange(n) if self.mode == "whole" else _odd_documents(data, offsets, self.special)
        ids, each = np.empty(0, np.int32), np.zeros(n, np.int64)
        if len(odd) < n and len(data):
            starts, ends, doc = self._segments(data, offsets)
            if len(odd):
                keep = ~np.isin(doc, odd)
                starts, ends, doc = starts[keep], ends[keep], doc[keep]
            h = kernel.span_hash(kernel.prefix_hash(data), starts, ends)
            at = self._find(h)
            unknown = np.flatnonzero(at < 0)
            if len(unknown):
                new, first = np.unique(h[unknown], return_index=True)
                first = unknown[first]
                body = data.tobytes()
                self._learn(new, [body[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                at = self._find(h)
                if (at < 0).any():  # this chunk alone needs more than was kept: entries dropped to make room come back
                    gone = np.flatnonzero(at < 0)
                    new, first = np.unique(h[gone], return_index=True)
                    first = gone[first]
                    limit, self.limit = self.limit, 1 << 62
                    self._learn(new, [body[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                    self.limit, at = limit, self._find(h)
            seen = np.bincount(at)
            self.hits[: len(seen)] += seen.astype(np.int32)
            size = self.size[at].astype(np.int64)
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[at] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
            each = kernel.counts(doc, n, size)
        if len(odd):
            texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd]
            parts = np.split(ids, np.cumsum(each)[:-1])
            for k, got in zip(odd.tolist(), self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                parts[k] = np.array(got.ids, np.int32)
            ids, each = np.concatenate(parts).astype(np.int32), np.fromiter(map(len, parts), np.int64, n)
        return ids, each

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for _, _, data, offsets in kernel.chunks(pa.array(texts, pa.large_string())):
            ids, each = self.encode(data, offsets)
            out += [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])]
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder for a file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, each: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text, and the offsets of the texts."""
    at = np.concatenate([[0], np.cumsum(each + 1)])
    out = np.empty(int(at[-1]), np.int32)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    out[own], out[at[1:] - 1] = ids, end_id
    return out, at

"""FM-index over a sequence of word symbols (numpy).

Symbol 0 is a separator; every separator counts as a symbol of its own, ordered by position, so suffixes
are told apart at the next separator at the latest. The Burrows-Wheeler transform is held as a wavelet
matrix of bit vectors with counts for each 64 bits; suffix positions are sampled at every SAMPLE-th
position and after each separator, so a walk back from any row ends soon.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def _order(hi: np.ndarray, lo: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Permutation that sorts by (hi, lo, index); all are below n."""
    bits = max(1, int(n).bit_length())
    if 3 * bits <= 63:
        place = np.arange(len(hi), dtype=np.uint64) if len(hi) < n else index.astype(np.uint64)
        # index ascends with place, so place serves as the last key
        key = ((hi.astype(np.uint64) << np.uint64(bits)) | lo.astype(np.uint64)) << np.uint64(bits) | place
        key.sort()
        return (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.lexsort((index, lo, hi))


def suffix_ranks(seq: np.ndarray, n_symbols: int) -> np.ndarray:
    """Rank of each suffix; seq ends with a separator."""
    n = len(seq)
    zero = seq == 0
    n_zero = int(zero.sum())
    # Distance to the next separator: a suffix compared that far is resolved, by position.
    ends = np.flatnonzero(zero)
    near = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    bits = max(1, int(n_symbols).bit_length())
    depth = max(1, min(8, 40 // bits))
    key = np.zeros(n, np.int64)
    padded = np.concatenate([seq.astype(np.int64), np.zeros(depth, np.int64)])
    live = np.ones(n, bool)
    for k in range(depth):
        key = (key << bits) | np.where(live, padded[k : k + n], 0)
        live &= padded[k : k + n] != 0
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(n_zero)
    rest = np.flatnonzero(~zero)
    if not len(rest):
        return rank
    width = max(1, int(n).bit_length())
    if depth * bits + width <= 63:
        packed = (key[rest].astype(np.uint64) << np.uint64(width)) | rest.astype(np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << width) - 1)).astype(np.int64)
    else:
        order = rest[np.argsort(key[rest], kind="stable")]

    def settle(order: np.ndarray, new: np.ndarray, base: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
        """Sets ranks of sorted suffixes and returns those still equal, in position order."""
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        single = new & np.append(new[1:], True)
        open_ = ~single & (near[order] >= depth)
        rank[order] = base + np.where(open_, place[first], place)
        return np.sort(order[open_])

    spot = np.arange(len(order))
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    left = settle(order, new, np.full(len(order), n_zero), spot, depth)
    while len(left):
        hi, lo = rank[left], rank[left + depth]
        by = _order(hi, lo, left, n)
        order, hi, lo = left[by], hi[by], lo[by]
        group = np.append(True, hi[1:] != hi[:-1])
        start = np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        new = group | np.append(True, lo[1:] != lo[:-1])
        depth *= 2
        left = settle(order, new, hi, np.arange(len(order)) - start, depth)
    return rank


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int):
        """seq: symbols 0 to n_symbols, ending with 0."""
        n = self.n = len(seq)
        rank = suffix_ranks(seq, n_symbols)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = seq[sa - 1]
        counts = np.bincount(seq, minlength=n_symbols + 1)
        self.C = np.cumsum(counts) - counts
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.marks = self._vector(sampled)
        self.samples = sa[sampled].astype(np.int32 if n < 1 << 31 else np.int64)
        self.levels = []
        part = bwt
        for level in reversed(range(max(1, int(n_symbols).bit_length()))):
            bit = (part >> level) & 1 == 1
            ones = part[bit]
            self.levels.append((level, n - len(ones), self._vector(bit)))
            part = np.concatenate([part[~bit], ones])
        # A symbol's rows in the last level begin at base.
        self.base = np.zeros(n_symbols + 1, np.int64)
        self.base = self._descend(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))

    @staticmethod
    def _vector(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).astype(np.int64)
        return words, np.cumsum(ones) - ones

    @staticmethod
    def _rank1(vector: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        words, before = vector
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, vector in self.levels:
            ones = self._rank1(vector, at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row at of the transform."""
        return self._descend(symbol, at) - self.base[symbol]

    def search(self, symbols: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) whose suffixes begin with each pattern: the sizes symbols (over 0) up to place last."""
        lo, hi = np.zeros(len(last), np.int64), np.full(len(last), self.n, np.int64)
        for step in range(int(sizes.max(initial=0))):
            act = np.flatnonzero((sizes > step) & (lo < hi))
            if not len(act):
                break
            c = symbols[last[act] - step]
            lo[act] = self.C[c] + self.rank(c, lo[act])
            hi[act] = self.C[c] + self.rank(c, hi[act])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back to the last sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        which, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(which):
            words, _ = self.marks
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[which[hit]] = self.samples[self._rank1(self.marks, at[hit])] + steps
            which, at = which[~hit], at[~hit]
            symbol, place = np.zeros(len(at), np.int64), at
            for _, zeros, vector in self.levels:
                bit = (vector[0][place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                ones = self._rank1(vector, place)
                place = np.where(bit, zeros + ones, place - ones)
                symbol = symbol * 2 + bit
            at = self.C[symbol] + place - self.base[symbol]
            steps += 1
        return out

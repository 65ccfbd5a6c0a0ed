"""Language-model scores by online logistic context mixing (operator 5).

A text is a sequence of words (runs of non-space bytes, A-Z lowered) and an end. A token is coded as bits: a
flag, whether it has stood in the text before; if not, its path in a code tree of the HEAD words that most
training texts have (the end and an escape are leaves too). CONTEXTS contexts predict every bit from counts of
the training texts: for flags the place in the text and the share of new words, the last flags, and the word
before; for paths the node with the place, with the last very frequent word, and with the word before; for the bytes of
words beyond the head the two, four and seven bytes before. A mixer adds the predictions up in the logistic
domain with weights chosen by a gate (place, depth, or byte position); each text begins with the corpus'
weights and refines them after every STEP bits of its own, from bits already coded. A repeated word is then
coded by its share of the text so far, and what a path leaves open below TOP bits by the words' shares among new
words after the last of the TOPICS most frequent words (grouped by what follows them, so that languages part).

Everything else that the corpus has is counted whole and joined: words beyond the head are coded by the number
of training texts that have them, and those that no other text has are spelled, bit by bit, by the mixer, whatever their number;
phrases (runs of words cut where a word's hash says so) are mixed with the words' own probability by the number
of other training texts with the same phrase. A training text's own share is left out of these counts, so that
a text is only known by others. All parts are sub-probabilities of one code, so bits_per_byte follows.

What travels to all tasks has a fixed size: HEAD words, SLOTS counts, HOT words and phrases that most texts have,
and a bitmap of phrases of several texts, which only spares look-ups. Word and phrase counts grow with the input and are joined by hash partition;
the HOT ones are looked up where they are met, so no key has many rows. Training texts are crc32(doc_id as text)
mod 7 not 2. Tables and first weights come from one pass over all training texts: a task predicts each piece by
what it has counted before, corrects its weights, then counts it; tasks' counts are summed and their mean weights
averaged by the bits of each gate. Words and phrases are compared by 64-bit hashes.

A text over PART bytes is read in pieces, cut at white space, with its state carried on, so memory is bounded by a
piece and the text's distinct words; phrases end at a piece's end, and its other pieces count as other texts for phrases.

Defined results: null and empty texts are an end alone; a null doc_id is held out; repeated rows are learned and
scored each; with no training text all counts are 0; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel
from .ngram_join import _bloom

HEAD, FREQUENT, NEAR, HOT = 1 << 17, 256, 1024, 4096
TOP = 6  # bits of a path that are mixed
TOPICS, GROUPS, PRIOR = 32, 8, 30.0  # most frequent words by which texts are told apart, groups of them, weight of all texts in a group's shares
CUT, LEAST_PHRASE = 16, 6  # a phrase ends at one word of CUT and counts from this many tokens on
CONTEXTS, STEP, RATE = 3, 256, 0.01
BLOCK = 1 << 13
LOT = 1 << 15  # bits of a step of fitting
PART = 128 << 10  # bytes of text handled at once
BITMAP = 1 << 26  # bits of a map of phrases that several texts have; of a full one more rows are joined, no score changes
_U = np.uint64
_END, _ESCAPE = 0, 1  # leaves before those of the words
_END_KEY = _U(1)
_ODD = _U(0xD6E8FEB86659FD93)

#: Slots of the counts: paths by place, last very frequent word, word before; flags; hashed bytes. All but bytes have a slot for each context.
_SIZES = (8 << TOP, (FREQUENT + 1) << TOP, (NEAR + 2) << TOP, 256, 512, (NEAR + 2) << 3, 1 << 17, 1 << 18, 1 << 18)
_BASES = np.cumsum((0, *_SIZES))
SLOTS = int(-(-_BASES[-1] // BLOCK) * BLOCK)
_FLAG_GATES, _PATH_GATES = 16, 2 * TOP
TEXT_GATES = _FLAG_GATES + _PATH_GATES
GATES = TEXT_GATES + 32


def _shannon(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(-weight, kind="stable")
    share = weight[by] / weight.sum()
    length = np.clip(np.ceil(-np.log2(share) - 1e-9), 1, 40).astype(np.int64)
    code = (np.concatenate([[0], np.cumsum(0.5 ** length[:-1])]) * 2.0**length).astype(np.int64)
    out_length, out_code = np.empty_like(length), np.empty_like(code)
    out_length[by], out_code[by] = length, code
    return out_length, out_code


def _byte_code() -> tuple[np.ndarray, np.ndarray]:
    """Lengths and codes of bytes, shorter for those that words have most; a fixed rule, which the predictors correct."""
    weight = np.full(256, 0.02)
    weight[0x80:0xC0], weight[0xC3], weight[48:58] = 0.05, 1.0, 0.1
    for k, c in enumerate(b" etaoinshrdlucmfgwypbvkjxqz"):
        weight[c] = 30.0 / (k + 3)
    weight[[ord("."), ord(",")]] = 1.0
    return _shannon(weight)


_BYTE_LENGTH, _BYTE_CODE = _byte_code()


class Lookup:
    """Places of 64-bit keys in a table of them; -1 where a key is not in it."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, int(2 * len(keys)).bit_length())
        self.mask, self.slots, self.keys = (1 << bits) - 1, np.full(1 << bits, -1, np.int32), keys
        left = np.arange(len(keys))
        at = (keys & _U(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left, at, want = np.arange(len(h)), (h & _U(self.mask)).astype(np.int64), h
        while len(left) and len(self.keys):
            entry = self.slots[at]
            good = (entry >= 0) & (self.keys[entry] == want)
            out[left[good]] = entry[good]
            more = (entry >= 0) & ~good
            left, at, want = left[more], (at[more] + 1) & self.mask, want[more]
        return out


class Vocabulary:
    """The head's words, by hash, with occurrences c and training texts d, and their codes: Shannon lengths by d, in canonical order."""

    def __init__(self, keys: np.ndarray, c: np.ndarray, d: np.ndarray, n_docs: int, d_rest: int):
        order = np.lexsort((keys, -d))
        keys, c, d = keys[order], c[order], d[order]
        weight = np.concatenate([[n_docs + 1, d_rest + 1], d]).astype(np.float64)
        length, code = _shannon(weight)
        below = length > TOP
        node = np.where(below, code >> np.maximum(length - TOP, 0), 0)
        total = np.bincount(node[below], weight[below], minlength=1)
        #: What a leaf has of the words below its node at TOP bits.
        self.node, self.share = np.where(below, node, -1), np.where(below, weight / np.maximum(total[node], 1), 1.0)
        self.length, self.code = np.minimum(length, TOP).astype(np.int32), np.where(below, node, code).astype(np.int32)
        self.log = np.concatenate([[np.log10(n_docs + 1.0), 0.0], np.log10(c + 1.0)])
        self.known = np.concatenate([[n_docs > 0, False], c > 0])
        leaf = np.arange(len(weight))
        self.topic = np.where((leaf >= 2) & (leaf < 2 + FREQUENT), leaf - 1, 0)
        self.near = np.where((leaf >= 2) & (leaf < 2 + NEAR), leaf - 1, 0)
        self.mark = np.where((leaf >= 2) & (leaf < 2 + TOPICS), leaf - 1, 0)
        self.lookup = Lookup(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Leaf of each word's hash; _ESCAPE where the head doesn't have it."""
        at = self.lookup.find(h)
        return np.where(at >= 0, at + 2, _ESCAPE)


class State:
    """What a long text's next piece needs of those before."""

    def __init__(self):
        self.keys, self.n = np.empty(0, _U), np.empty(0, np.int64)
        self.tokens, self.new, self.phrases = 0, 0, 0
        self.last, self.topic, self.mark = -1, 0, 0  # leaf of the last token; the last very frequent word; the last of the TOPICS
        self.flags, self.before = 0, 0  # the last two flags; how often the last token had stood before
        self.weights: np.ndarray | None = None

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        own, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.keys, self.n = own, np.bincount(at, np.concatenate([self.n, n]), minlength=len(own)).astype(np.int64)

    def seen(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, State | None, bool]]:
    """(first row, end row, bytes, offsets, state, ends): whole texts without a state, or a piece of one long text."""
    for a, b, data, offsets in kernel.chunks(column, PART):
        if len(data) <= PART:
            yield a, b, data, offsets, None, True
            continue
        state, at = State(), 0
        while True:
            end = min(len(data), at + PART)
            if end < len(data):
                gaps = np.flatnonzero(kernel.SPACE[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a piece stays whole
                    step = end
                    while step < len(data) and not kernel.SPACE[data[step : step + PART]].any():
                        step += PART
                    end = min(len(data), step + int(np.argmax(kernel.SPACE[data[step : step + PART]])) + 1) if step < len(data) else len(data)
            yield a, b, data[at:end], np.array([0, end - at]), state, end == len(data)
            if end == len(data):
                break
            at = end


def _occurrences(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how often each key stands before its place, first places of the distinct keys, times of these)."""
    n = len(key)
    order = None
    if n < 1 << 18:
        packed = (key & ~_U((1 << 18) - 1)) | np.arange(n, dtype=_U)
        packed.sort()
        order = (packed & _U((1 << 18) - 1)).astype(np.int64)
        own, short = key[order], packed >> _U(18)
        if ((own[1:] != own[:-1]) & (short[1:] == short[:-1])).any():
            order = None
    if order is None:
        order = np.argsort(key, kind="stable")
        own = key[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if n else np.empty(0, np.int64)
    times = np.diff(np.append(first, n))
    before = np.empty(n, np.int64)
    before[order] = np.arange(n) - np.repeat(first, times)
    return before, order[first], times


class Tokens:
    """Tokens and phrases of a piece: whole texts, or a part of one with its state."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, state: State | None, ends: bool):
        n = self.n = len(offsets) - 1
        self.data, self.starts, self.ends, doc, h = data, *kernel.word_hashes(data, offsets, kernel.NOT_SPACE)
        self.total = total = len(doc) + (n if ends else 0)
        self.spot = np.arange(len(doc)) + (doc if ends else 0)
        each = kernel.counts(doc, n) + int(ends)
        self.owner = np.repeat(np.arange(n), each)
        self.key = np.full(total, _END_KEY)
        self.key[self.spot] = h
        self.is_word = np.zeros(total, bool)
        self.is_word[self.spot] = True
        self.first = np.cumsum(each) - each
        self.each = each
        salt = kernel.mix(np.arange(1, n + 1, dtype=_U))[self.owner]
        self.before, self.distinct, self.times = _occurrences(kernel.mix(self.key ^ salt))
        self.place = np.arange(total) - self.first[self.owner]
        if state is not None:
            self.before += state.seen(self.key)
            self.place += state.tokens
        self.new = self.before == 0
        # Phrases.
        cut = (self.key % _U(CUT) == 0) | ~self.is_word
        if total:
            cut[-1] = True
        self.phrase = np.cumsum(cut) - cut
        self.phrase_end = np.flatnonzero(cut) + 1
        self.phrase_start = np.append(0, self.phrase_end[:-1])[: len(self.phrase_end)]
        size = self.phrase_end - self.phrase_start
        p, q = kernel._powers(total + 1)
        sums = np.zeros(total + 1, _U)
        np.cumsum(kernel.mix(self.key + _U(0x632BE59BD9B4E019)) * p[:total], out=sums[1:])
        self.phrase_key = kernel.mix((sums[self.phrase_end] - sums[self.phrase_start]) * q[self.phrase_start] + size.astype(_U))
        self.phrase_owner = self.owner[self.phrase_start]
        self.long = size >= LEAST_PHRASE

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how often each phrase stands before in its text's piece, numbers of the distinct ones, times of these)."""
        return _occurrences(kernel.mix(self.phrase_key ^ kernel.mix(self.phrase_owner.astype(_U) + _U(1))))

    def carry(self, state: State, bits: Bits | None = None) -> None:
        """Puts the end of this piece into the state."""
        own = self.distinct[self.is_word[self.distinct]]
        state.add(self.key[own], self.times[self.is_word[self.distinct]])
        state.tokens += self.total
        state.new += int(self.new.sum())
        state.phrases += len(self.phrase_end)
        if self.total:
            state.before = int(self.before[-1])
            for new in self.new[-2:]:
                state.flags = (2 * state.flags + int(not new)) & 3
            if bits is not None:
                state.last, state.topic, state.mark = int(bits.leaf[-1]), int(bits.topic_here[-1]), int(bits.mark_here[-1])


def _cheap(h: np.ndarray) -> np.ndarray:
    h = h * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


class Bits:
    """The bits of flags and paths of a piece, in no order: bit, slots (one for each context), gate, token, place (order in the text)."""

    def __init__(self, v: Vocabulary, t: Tokens, state: State | None):
        total, owner, first = t.total, t.owner, t.first
        leaf = np.zeros(total, np.int64)
        leaf[t.spot] = v.find(t.key[t.spot])
        self.leaf = leaf
        begin = np.zeros(total, bool)
        begin[first[t.each > 0]] = True
        shift = lambda x, at: np.where(begin, at, np.append(at, x[:-1])) if total else x
        # The word before: one of the NEAR, another, or none.
        none = NEAR + 1
        prev = shift(v.near[leaf], none if state is None or state.last < 0 else int(v.near[state.last]))
        mark = np.where(v.topic[leaf] > 0, np.arange(total), -1)
        upto = np.maximum.accumulate(mark) if total else mark
        topic_here = np.where(upto >= first[owner], v.topic[leaf[upto]], 0 if state is None else state.topic)
        topic = shift(topic_here, 0 if state is None else state.topic)
        # Flags: none at the first token.
        old = (~t.new).astype(np.int64)
        one = shift(old, 0 if state is None else state.flags & 1)
        two = shift(one, 0 if state is None else state.flags >> 1)
        grade = np.minimum(np.frexp(t.place + 1.0)[1].astype(np.int64) - 1, 15)
        news = np.cumsum(t.new) - t.new
        news = news - news[first[owner]] + (0 if state is None else state.new) if total else news
        share = 15 * news // np.maximum(t.place, 1)
        times = np.minimum(shift(t.before, 0 if state is None else state.before), 7)
        asked = np.flatnonzero(t.place > 0)
        flag_slots = (_BASES[3] + 16 * grade + share, _BASES[4] + 32 * grade + 16 * two + 8 * one + times, _BASES[5] + 8 * prev + np.minimum(grade, 7))
        # Paths of new tokens.
        fresh = np.flatnonzero(t.new)
        own = leaf[fresh]
        length = v.length[own]
        n_bits = (t.place > 0).astype(np.int32)
        n_bits[fresh] += length
        begins = np.cumsum(n_bits, dtype=np.int32) - n_bits
        self.each = kernel.counts(owner, t.n, n_bits)
        order = begins - (np.cumsum(self.each) - self.each).astype(np.int32)[owner] if total else begins
        # One row for each bit: what its token gives, less the node.
        which = np.repeat(np.arange(len(fresh), dtype=np.int32), length)
        depth = np.arange(len(which), dtype=np.int32) - (np.cumsum(length, dtype=np.int32) - length)[which]
        up = v.code[own][which] >> (length[which] - depth - 1)
        node = (up >> 1) | (np.int32(1) << depth)
        narrow = lambda x: x.astype(np.int32)
        path_slots = (narrow((np.minimum(grade[fresh], 15) >> 1) << TOP)[which] + node, narrow(_BASES[1] + (topic[fresh] << TOP))[which] + node, narrow(_BASES[2] + (prev[fresh] << TOP))[which] + node)
        self.bit = np.concatenate([narrow(old[asked]), up & 1])
        self.slots = [np.concatenate([narrow(f[asked]), p]) for f, p in zip(flag_slots, path_slots, strict=True)]
        self.gate = np.concatenate([narrow(grade[asked]), _FLAG_GATES + 2 * depth])
        self.n_flags = len(asked)
        self.token = np.concatenate([narrow(asked), narrow(fresh)[which]])
        self.place = np.concatenate([order[asked], (order[fresh] + (t.place[fresh] > 0).astype(np.int32))[which] + depth])
        self.owner = np.concatenate([narrow(owner[asked]), narrow(owner[fresh])[which]])
        self.topic_here = topic_here
        # The last of the TOPICS words before a token.
        upto = np.maximum.accumulate(np.where(v.mark[leaf] > 0, np.arange(total), -1)) if total else mark
        self.mark_here = np.where(upto >= first[owner], v.mark[leaf[upto]], 0 if state is None else state.mark)
        self.mark = shift(self.mark_here, 0 if state is None else state.mark)


class Spelled:
    """The bits of the bytes of words, and a space after each; slots and gates as Bits has them, and the word's number."""

    def __init__(self, t: Tokens, words: np.ndarray):
        first, m = t.starts[words], t.ends[words] - t.starts[words] + 1
        own = np.repeat(np.arange(len(words)), m)
        head = np.cumsum(m) - m
        j = np.arange(len(own)) - head[own]
        byte = kernel.LOWER[t.data[np.minimum(first[own] + j, max(len(t.data) - 1, 0))]] if len(own) else np.empty(0, np.uint8)
        byte[head + m - 1] = 32
        wide = byte.astype(_U)
        past = np.zeros(len(byte), _U)
        for k in range(1, 8):
            past[k:] |= np.where(j[k:] >= k, wide[:-k], _U(0)) << _U(8 * (k - 1))
        size = _BYTE_LENGTH[byte].astype(np.int32)
        which = np.repeat(np.arange(len(byte), dtype=np.int32), size)
        depth = np.arange(len(which), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        up = _BYTE_CODE[byte][which] >> (size[which] - depth - 1)
        self.bit = (up & 1).astype(np.int32)
        node = ((up >> 1) | (np.int64(1) << depth)).view(_U) * _ODD
        self.slots = []
        for k, (keep, salt) in enumerate(((0xFFFF, 1 << 60), (0xFFFFFFFF, 1 << 61), ((1 << 64) - 1, 3 << 60))):
            h = (_cheap((past & _U(keep)) + _U(salt))[which] + node) * _U(0x9E3779B97F4A7C15)
            self.slots.append((h >> _U(65 - _SIZES[6 + k].bit_length())).astype(np.int32) + np.int32(_BASES[6 + k]))
        self.gate = (TEXT_GATES + 8 * np.minimum(j, 3)[which] + np.minimum(depth, 7)).astype(np.int32)
        self.word = own[which]
        self.n_flags = 0


def rare_words(t: Tokens, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens in the piece, times) of each text's distinct words beyond the head."""
    some = leaf[t.distinct] == _ESCAPE
    return t.distinct[some], t.times[some]


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = (keys % _U(BITMAP)).astype(np.int64)
    return (bitmap[spot >> 6] >> (spot & 63).astype(_U)) & _U(1) == 1


def spelled_blocks(t: Tokens, tokens: np.ndarray) -> Iterator[tuple[int, int, Spelled]]:
    """Words (by their tokens) in runs of about PART bytes, so that many or long ones don't meet at once."""
    words = np.searchsorted(t.spot, tokens)
    ends = np.cumsum(t.ends[words] - t.starts[words] + 1)
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        yield at, end, Spelled(t, words[at:end])
        at = end


def _stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of a 1 by the counts, nearer to 0 the fewer there are."""
    n = n0 + n1
    return (np.log((n1 + 0.3) / (n0 + 0.3)) * (n / (n + 1.0))).astype(np.float32)


def _inputs(stretch, b) -> tuple[np.ndarray, np.ndarray]:
    """(CONTEXTS + 1 rows of inputs, turned so that a right guess is positive; gate) of the bits."""
    x = np.empty((CONTEXTS + 1, len(b.bit)), np.float32)
    for k in range(CONTEXTS):
        stretch.take(b.slots[k], out=x[k], mode="clip")
    x[CONTEXTS] = 0.3
    gate = b.gate.copy()
    gate[b.n_flags :] += (x[CONTEXTS - 1, b.n_flags :] != 0) & (gate[b.n_flags :] < TEXT_GATES)
    x *= (2 * b.bit - 1).astype(np.float32)
    return x, gate


class Model:
    def __init__(self, n0: np.ndarray, n1: np.ndarray, weights: np.ndarray | None = None):
        self.stretch = _stretched(n0.astype(np.float64), n1.astype(np.float64))
        self.weights = start_weights() if weights is None else weights

    def spelled(self, b: Spelled, n: int) -> np.ndarray:
        """Log probability (natural) of each of n words."""
        x, gate = _inputs(self.stretch, b)
        z = sum(x[k] * self.weights[:, k].take(gate) for k in range(CONTEXTS + 1))
        return -np.bincount(b.word, np.log1p(np.exp(-np.clip(z, -20, 20))), minlength=n)

    def score(self, b: Bits, state: State | None, n_tokens: int) -> np.ndarray:
        """Log probability (natural) of each token's bits; a text's weights are refined STEP bits by STEP bits."""
        x, gate = _inputs(self.stretch, b)
        n = len(b.each)
        step = b.place // STEP
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        edges = np.searchsorted(step[order], np.arange(int(step.max()) + 2)) if len(step) else [0]
        # Texts by falling length: those that still have bits come first.
        rank = np.empty(n, np.int64)
        rank[by := np.argsort(-b.each, kind="stable")] = np.arange(n)
        active = np.searchsorted(-b.each[by], -np.arange(len(edges) - 1) * STEP, side="left")
        lane = (rank[b.owner] * TEXT_GATES + gate)[order]
        xs = np.ascontiguousarray(x[:, order])
        own_weights = self.weights[:TEXT_GATES] if state is None or state.weights is None else state.weights
        w = np.ascontiguousarray(np.tile(own_weights, (n, 1)).T)
        loss = np.empty(len(lane), np.float32)
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own, own_x = lane[lo:hi], xs[:, lo:hi]
            z = own_x[0] * w[0].take(own)
            for c in range(1, CONTEXTS + 1):
                z += own_x[c] * w[c].take(own)
            np.clip(z, -20, 20, out=z)
            np.negative(z, out=z)
            np.exp(z, out=z)
            np.log1p(z, out=loss[lo:hi])
            if hi < len(lane) or state is not None:
                z /= 1 + z
                z *= np.float32(RATE)
                top = int(active[k]) * TEXT_GATES
                for c in range(CONTEXTS + 1):
                    w[c, :top] += np.bincount(own, z * own_x[c], minlength=top)
        if state is not None:
            state.weights = np.ascontiguousarray(w.T)
        return -np.bincount(b.token[order], loss, minlength=n_tokens)


class Fit:
    """Counts of a task's texts, and weights fitted on each bit by the counts before it."""

    def __init__(self):
        self.n = np.zeros((SLOTS, 2), np.int32)
        self.stretch, self.added = np.zeros(SLOTS, np.float32), 0
        self.w = start_weights()
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)
        self.steps = np.zeros((GATES, 1))
        self.sum, self.share = np.zeros(self.w.shape), np.zeros((GATES, 1))
        self.bits = np.zeros(GATES, np.int64)

    def add(self, b) -> None:
        if not len(b.bit):
            return
        # Predictions are renewed after 2, 4, 8, ... and then every 64 additions.
        if self.added in (2, 4, 8, 16, 32) or self.added % 64 == 0:
            self.stretch = _stretched(self.n[:, 0].astype(np.float32), self.n[:, 1].astype(np.float32))
        self.added += 1
        x, gate = _inputs(self.stretch, b)
        lots = -(-len(b.bit) // LOT)
        for lot in range(lots):
            self._step(np.ascontiguousarray(x[:, lot::lots]), gate[lot::lots])
        flat = self.n.reshape(-1)
        for slots in b.slots:
            np.add.at(flat, 2 * slots + b.bit, np.int32(1))

    def _step(self, x: np.ndarray, gate: np.ndarray) -> None:
        z = sum(x[k] * self.w[:, k].take(gate) for k in range(CONTEXTS + 1))
        np.clip(z, -20, 20, out=z)
        np.exp(z, out=z)
        z += 1
        push = np.divide(1, z, out=z)
        n = np.bincount(gate, minlength=GATES)
        own = n > 0
        g = (np.stack([np.bincount(gate, push * x[k], minlength=GATES) for k in range(CONTEXTS + 1)], axis=1) / np.maximum(n, 30)[:, None])[own]
        self.steps[own] += 1
        self.m[own], self.v[own] = 0.9 * self.m[own] + 0.1 * g, 0.98 * self.v[own] + 0.02 * g * g
        t = self.steps[own]
        self.w[own] += (0.02 * (self.m[own] / (1 - 0.9**t)) / (np.sqrt(self.v[own] / (1 - 0.98**t)) + 1e-4)).astype(np.float32)
        # Later weights count more in the mean.
        self.sum[own] += t * self.w[own]
        self.share[own] += t
        self.bits += n


def grouped_tails(v: Vocabulary, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each of the TOPICS words and of none, log share of each leaf among those below its node after a group's words).

    n counts new tokens by the last TOPICS word before them and leaf. Rows of similar words are one group, so that
    each has many counts: the two most alike are joined until GROUPS are left. Shares lean on those of all texts.
    """
    members = [[k] for k in range(TOPICS + 1)]
    sums = list(n)
    while len(members) > GROUPS:
        unit = np.stack([np.sqrt(x, dtype=np.float32) / np.float32(max(np.sqrt(x.sum()), 1)) for x in sums])
        close = unit @ unit.T
        del unit
        np.fill_diagonal(close, -1)
        # A row without counts goes to any other.
        a, b = sorted(divmod(int(close.argmax()), len(members)))
        members[a] += members.pop(b)
        sums[a] = sums[a] + sums.pop(b)
    group, out = np.zeros(TOPICS + 1, np.int64), np.zeros((len(members), len(v.share)), np.float32)
    below = v.node >= 0
    for k, (own, row) in enumerate(zip(members, sums, strict=True)):
        group[own] = k
        total = np.bincount(v.node[below], row[below], minlength=1 << TOP)
        out[k] = np.where(below, np.log((row + PRIOR * v.share) / (total[v.node] + PRIOR)), 0)
    return group, out


def start_weights() -> np.ndarray:
    start = np.zeros((GATES, CONTEXTS + 1), np.float32)
    start[:, :CONTEXTS] = 0.4
    return start


def averaged(fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The mean of fits' (weights, bits of each gate) by bits; a gate without bits keeps its start."""
    out, total = np.zeros((GATES, CONTEXTS + 1)), np.zeros((GATES, 1))
    for w, n in fits:
        out += w * n[:, None]
        total += n[:, None]
    return np.where(total > 0, out / np.maximum(total, 1), start_weights()).astype(np.float32)


_WORD, _PHRASE, _TOTAL = 0, 1, 2  # kinds of counts
_COUNTS = "kind int, key long, c long, d long, m long"


def _count(batches):
    """Counts of words and phrases: c in training texts (words: occurrences), d training texts, m all texts; totals of phrases: c first ones, d repeated ones."""
    held: list[list[np.ndarray]] = [[], []]
    total, repeated, size = 0, 0, 0

    def merged(kind):
        key, at = np.unique(np.concatenate([x[0] for x in held[kind]]), return_inverse=True)
        return [key, *(np.bincount(at, np.concatenate([x[k] for x in held[kind]]), minlength=len(key)).astype(np.int64) for k in (1, 2, 3))]

    def out(kind, key, *n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), *map(pa.array, n)], ["kind", "key", "c", "d", "m"])

    for batch in batches:
        learned = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, data, offsets, state, ends in pieces(batch.column(0)):
            t, mine = Tokens(data, offsets, state, ends), learned[a:b]
            own = t.is_word[t.distinct]
            at, times = t.distinct[own], t.times[own]
            trained, new = mine[t.owner[at]].astype(np.int64), t.new[at].astype(np.int64)
            held[_WORD].append([t.key[at], trained * times, trained * new, new])
            before, at, times = t.phrases()
            at = at[t.long[at]]
            trained = mine[t.phrase_owner[at]].astype(np.int64)
            held[_PHRASE].append([t.phrase_key[at], trained, trained, np.ones(len(at), np.int64)])
            total += int(trained.sum())
            repeated += int((mine[t.phrase_owner] & t.long & (before > 0)).sum())
            size += len(held[_WORD][-1][0]) + len(at)
            if state is not None:
                t.carry(state)
            if size > 600_000:
                for kind in (_WORD, _PHRASE):
                    if held[kind]:
                        held[kind] = [merged(kind)]
                size = sum(len(x[0][0]) for x in held if x)
                if size > 400_000:
                    for kind in (_WORD, _PHRASE):
                        if held[kind]:
                            yield out(kind, *held[kind][0])
                            held[kind] = []
                    size = 0
    for kind in (_WORD, _PHRASE):
        if held[kind]:
            yield out(kind, *merged(kind))
    yield out(_TOTAL, np.zeros(1, _U), *(np.array([x], np.int64) for x in (total, repeated, 0)))


def _packed(own: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """A block's counts: which are not 0 (a bitmap, or places where that is shorter), their low bytes, and the rest of large ones."""
    bitmap = np.packbits(own != 0).tobytes()
    more_at = np.flatnonzero(own >= 256)
    return at.astype(np.uint16).tobytes() if 2 * len(at) < len(bitmap) else bitmap, own[at].astype(np.uint8).tobytes(), more_at.astype(np.uint16).tobytes(), (own[more_at] >> 8).tobytes()


def _add_packed(total: np.ndarray, at: bytes, low: bytes, more_at: bytes, more: bytes) -> None:
    total[np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8))) if len(at) == len(total) // 8 else np.frombuffer(at, np.uint16)] += np.frombuffer(low, np.uint8)
    total[np.frombuffer(more_at, np.uint16)] += np.frombuffer(more, np.int32).astype(np.int64) << 8


_LEARNED = "block int, at binary, low binary, more_at binary, more binary"


def _learn(vocabulary):
    """A task's counts by blocks, and its weights as block -1 (at: weights, low: bits of each gate)."""

    def run(batches):
        v, fit = vocabulary.value, Fit()
        after = np.zeros((TOPICS + 1) * len(v.share), np.int32)
        for batch in batches:
            for _, _, data, offsets, state, ends in pieces(batch.column(0)):
                t = Tokens(data, offsets, state, ends)
                b = Bits(v, t, state)
                fit.add(b)
                np.add.at(after, b.mark[t.new] * len(v.share) + b.leaf[t.new], np.int32(1))
                # Words beyond the head show what new ones look like.
                first, _ = rare_words(t, b.leaf)
                for _, _, s in spelled_blocks(t, first[t.new[first]]):
                    fit.add(s)
                if state is not None:
                    t.carry(state, b)
        names = [x.split()[0] for x in _LEARNED.split(", ")]
        if not fit.bits.any():
            return
        mean = fit.sum / np.maximum(fit.share, 1)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in (mean.tobytes(), fit.bits.tobytes(), b"", b""))], names)
        after = np.pad(after, (0, -len(after) % (2 * BLOCK)))
        for first, flat in ((0, fit.n.reshape(-1)), (2 * SLOTS, after)):
            for a in range(0, len(flat), 2 * BLOCK):
                own = flat[a : a + 2 * BLOCK]
                at = np.flatnonzero(own)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([(first + a) // (2 * BLOCK)], pa.int32()), *(pa.array([x], pa.binary()) for x in _packed(own, at))], names)

    return run


def _add_learned(batches):
    """Sums of each block, in 64 bits, added up as rows come, and the averaged weights as block -1; rows come sorted by block."""
    block, total, fits = None, None, []

    def out(k, raw):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["block", "counts"])

    for batch in batches:
        for k, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k < 0:
                fits.append((np.frombuffer(raw[0], np.float64).reshape(GATES, CONTEXTS + 1), np.frombuffer(raw[1], np.int64)))
                if len(fits) > 64:
                    fits = [(averaged(fits).astype(np.float64), sum(n for _, n in fits))]
                continue
            if k != block:
                if block is not None:
                    yield out(block, total.tobytes())
                block, total = k, np.zeros(2 * BLOCK, np.int64)
            _add_packed(total, *raw)
    if block is not None:
        yield out(block, total.tobytes())
    if fits:
        yield out(-1, averaged(fits).tobytes())


class Scorer:
    """What scoring needs: vocabulary, model, the counts to join, those of HOT keys, and totals."""

    def __init__(self, **own):
        self.__dict__.update(own)


def train(docs: DataFrame, head: int = HEAD) -> Scorer:
    """Learns from the rows of docs that are not held out; head is the most words with codes of their own."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(common.text_of().alias("text"), (~common.held_out("doc_id", 7, 2)).alias("learned"))
    counted = rows.mapInArrow(_count, _COUNTS).groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in "cdm"])
    # A phrase that one text has tells nothing of another.
    counts = common.written(counted.filter((F.col("kind") != _PHRASE) | ((F.col("m") > 1) & (F.col("c") > 0))), "counts")
    word, phrase = F.col("kind") == _WORD, F.col("kind") == _PHRASE
    when = lambda x, y: F.coalesce(F.sum(F.when(x, y)), F.lit(0)).cast("long")
    n_words, n_distinct, d_all, once, twice, n_phrases, repeats, elsewhere = counts.agg(
        when(word, F.col("c")), when(word & (F.col("c") > 0), F.lit(1)), when(word, F.col("d")), when(word & (F.col("d") == 1), F.lit(1)), when(word & (F.col("d") == 2), F.lit(1)),
        when(F.col("kind") == _TOTAL, F.col("c")), when(F.col("kind") == _TOTAL, F.col("d")), when(phrase & (F.col("c") > 1), F.col("c")),
    ).first()
    n_docs = rows.filter("learned").count()
    table = lambda df: [c.to_numpy() for c in df.select("key", "c", "d").toArrow().combine_chunks().columns]
    key, c, d = table(counts.filter(word & (F.col("d") > 1)).orderBy(F.desc("d"), "key").limit(head))
    key = key.view(np.uint64)
    d_rest = int(d_all - d.sum())
    # Words that training texts have once tell how likely new ones are, those they have twice how likely the former come again.
    v = Vocabulary(key, c, d, n_docs, d_rest)
    # Words and phrases that most texts have and the head has not: their counts travel, so that no key to join has many rows.
    hot = [table(counts.filter(k).orderBy(F.desc("m"), "key").limit(n)) for k, n in ((word, head + HOT), (phrase, HOT))]
    keep = v.find(hot[0][0].view(np.uint64)) == _ESCAPE
    hot[0] = [x[keep] for x in hot[0]]
    bitmap = _bloom(counts.filter(phrase).select(F.col("key").alias("node")), BITMAP)
    shared = spark.sparkContext.broadcast(v)
    learned = rows.filter("learned").select("text").mapInArrow(_learn(shared), _LEARNED)
    learned = learned.repartition("block").sortWithinPartitions("block").mapInArrow(_add_learned, "block int, counts binary").toArrow()
    size = (TOPICS + 1) * len(v.share)
    n, weights = np.zeros(2 * SLOTS + size + -size % (2 * BLOCK), np.int64), start_weights()
    for block, raw in zip(learned.column(0).to_pylist(), learned.column(1), strict=True):
        if block < 0:
            weights = np.frombuffer(raw.as_buffer(), np.float32).reshape(GATES, CONTEXTS + 1)
        else:
            n[block * 2 * BLOCK : (block + 1) * 2 * BLOCK] = np.frombuffer(raw.as_buffer(), np.int64)
    del learned
    tails = grouped_tails(v, n[2 * SLOTS : 2 * SLOTS + size].reshape(TOPICS + 1, -1))
    n0, n1 = n[0 : 2 * SLOTS : 2], n[1 : 2 * SLOTS : 2]
    kernel.release()
    lookups = [(Lookup(k.view(np.uint64)), c, d) for k, c, d in hot]
    known = float(np.clip(elsewhere / max(n_phrases, 1), 0.001, 0.5))
    again = float(np.clip(repeats / max(n_phrases + repeats, 1), 0.001, 0.3))
    model = spark.sparkContext.broadcast((Model(n0, n1, weights), tails, lookups, bitmap, known, again))
    return Scorer(
        vocabulary=shared, model=model, counts=counts.filter(F.col("kind") != _TOTAL).select("kind", "key", "c", "d"), n_tokens=int(n_words) + n_docs, n_distinct=int(n_distinct) + (n_docs > 0),
        d_rest=max(d_rest, 1), new=float((once + 1) / (once + 2 * twice + max(d_rest - once, 0) + 2)), n_phrases=max(int(n_phrases), 1), known=known,
    )


_ROW = "row long, doc_id long, learned boolean, phrase long, kind int, key long, c0 long, d0 long, n long, fresh boolean, spelled double, n_tokens long, n_known long, log_sum double, ln double, n_bytes long"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_NONE = -1  # a row that looks nothing up; its key spreads such rows


def _score(vocabulary, model):
    def run(batches):
        v, (m, (group, tails), hot, bitmap, known, again) = vocabulary.value, model.value
        rest = np.log(1 - known - again)
        for batch in batches:
            for a, b, data, offsets, state, ends in pieces(batch.column(3)):
                t = Tokens(data, offsets, state, ends)
                bits = Bits(v, t, state)
                leaf, owner, n = bits.leaf, t.owner, b - a
                ln = m.score(bits, state, t.total)
                ln[t.new] += tails[group[bits.mark[t.new]], leaf[t.new]]
                old = np.flatnonzero(~t.new)
                ln[old] += np.log(t.before[old] / t.place[old])
                base = state.phrases if state is not None else 0
                # Phrases: once more in the text, perhaps elsewhere, or neither.
                phrase_ln = rest + (np.add.reduceat(ln, t.phrase_start) if t.total else ln)
                before, distinct, _ = t.phrases()
                repeat = np.flatnonzero(t.long & (before > 0))
                nth = np.arange(len(before)) - np.searchsorted(t.phrase_owner, t.phrase_owner) if len(before) else before
                phrase_ln[repeat] = np.logaddexp(phrase_ln[repeat], np.log(again * before[repeat] / nth[repeat]))
                distinct = np.sort(distinct[t.long[distinct]])
                asked = distinct[marked(bitmap, t.phrase_key[distinct])]
                is_asked = np.zeros(len(before), bool)
                is_asked[asked] = True
                text_ln = np.bincount(t.phrase_owner[~is_asked], phrase_ln[~is_asked], minlength=n)
                # Words beyond the head.
                first, times = rare_words(t, leaf)
                fresh = t.new[first]
                spelled, mixed = np.zeros(len(first)), np.flatnonzero(fresh)
                for at, end, s in spelled_blocks(t, first[mixed]):
                    spelled[mixed[at:end]] = m.spelled(s, end - at)
                in_phrase = np.where(is_asked[t.phrase[first]], t.phrase[first] + base, -1)

                counts = [n, len(first), len(asked)]
                rows = [batch.column(k).slice(a, n) for k in (0, 1, 2)]
                take = pa.array(np.concatenate([np.arange(n), owner[first], t.phrase_owner[asked]]))
                key = np.concatenate([rows[0].to_numpy(), t.key[first].view(np.int64), t.phrase_key[asked].view(np.int64)])
                kind = np.repeat([_NONE, _WORD, _PHRASE], counts)
                c0, d0, missing = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.ones(len(key), bool)
                for k, (lookup, c, d) in enumerate(hot):
                    mine = np.flatnonzero(kind == k)
                    at = lookup.find(key[mine].view(_U))
                    mine, at = mine[at >= 0], at[at >= 0]
                    c0[mine], d0[mine], missing[mine] = c[at], d[at], False
                # What is known here looks nothing up: the key then is any that spreads.
                looks = np.where(missing, kind, _NONE)
                spread = np.where(missing, key, kernel.mix(np.arange(len(key), dtype=_U) + key.view(_U)).view(np.int64))
                value = lambda x, t_: np.concatenate([x, np.zeros(counts[1] + counts[2], t_)]).astype(t_)
                arrays = [
                    *(r.take(take) for r in rows), np.concatenate([np.full(n, -1), in_phrase, asked + base]), looks.astype(np.int32), spread,
                    pa.array(c0, mask=missing), pa.array(d0, mask=missing), np.concatenate([np.zeros(n, np.int64), times, np.full(len(asked), -1)]), np.concatenate([np.zeros(n, bool), fresh, np.zeros(len(asked), bool)]),
                    np.concatenate([np.zeros(n), spelled, np.zeros(len(asked))]), value(t.each, np.int64), value(np.bincount(owner[v.known[leaf]], minlength=n), np.int64), value(np.bincount(owner, v.log[leaf], minlength=n), np.float64),
                    np.concatenate([text_ln, np.zeros(len(first)), phrase_ln[asked]]), value(np.diff(offsets), np.int64),
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], _NAMES)
                if state is not None:
                    t.carry(state, bits)

    return run


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """A row for each row of docs: held_out, token counts, base_score, score (log10), bits_per_byte of the text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (~common.held_out("doc_id", 7, 2)).alias("learned"), common.text_of().alias("text"))
    parts = rows.mapInArrow(_score(scorer.vocabulary, scorer.model), _ROW)
    joined = parts.join(scorer.counts, ["kind", "key"], "left")
    c, d = F.coalesce("c0", "c", F.lit(0)), F.coalesce("d0", "d", F.lit(0))
    # Of a phrase (n is -1) other training texts; of a word those too, or it is spelled.
    others = F.when(F.col("n") == -1, c - F.col("learned").cast("long"))
    is_word = F.col("n") > 0
    d_others = d - F.col("learned").cast("long")
    word_ln = F.when(F.col("fresh"), F.when(d_others > 0, F.log(d_others * F.lit((1 - scorer.new) / scorer.d_rest))).otherwise(F.col("spelled") + F.lit(float(np.log(scorer.new)))))
    phrases = joined.groupBy("row", "doc_id", "phrase").agg(
        F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.sum(F.when(is_word & (c > 0), F.col("n")).otherwise(0))).alias("n_known"),
        F.sum("log_sum").alias("head"), F.sum(F.when(is_word, F.col("n") * F.log10(c + F.lit(1.0))).otherwise(0.0)).alias("rest"),
        (F.sum("ln") + F.sum(F.coalesce(word_ln, F.lit(0.0)))).alias("ln"), F.max(others).alias("others"), F.sum("n_bytes").alias("n_bytes"),
    )
    whole = F.log(F.col("others") * F.lit(scorer.known / scorer.n_phrases))
    mixed = F.when((F.col("phrase") >= 0) & (F.col("others") > 0), F.greatest("ln", whole) + F.log1p(F.exp(-F.abs(F.col("ln") - whole)))).otherwise(F.col("ln"))
    sums = phrases.withColumn("ln", mixed).groupBy("row", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "head", "rest", "ln", "n_bytes")])
    one = float(np.log10(float(scorer.n_tokens + scorer.n_distinct + 1)))
    return sums.select(
        "doc_id", common.held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(scorer.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("rest") - F.col("n_tokens") * F.lit(one)).alias("base_score"), (F.col("ln") / F.lit(float(np.log(10)))).alias("score"),
        (-F.col("ln") / F.lit(float(np.log(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs))

"""Language-model scores against plain Python, and what they are made of."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import kernel, lm_score

from .test_llm import LOW, SOLID, _docs, _texts

BASES = lm_score._BASES.tolist()
END = int(lm_score._END_KEY)


def _mask(x):
    return x & (1 << 64) - 1


def _cheap(x):
    x = _mask(x * 0x9E3779B97F4A7C15)
    return x ^ (x >> 32)


def _loss(xs, weights):
    return math.log1p(math.exp(-max(-20.0, min(20.0, sum(w * x for w, x in zip(weights, xs, strict=True))))))


def _inputs(model, bit, slots):
    return [(2 * bit - 1) * float(model.stretch[s]) for s in slots] + [(2 * bit - 1) * 0.3]


def _spelled(model, word):
    total, past = 0.0, b""
    for j, c in enumerate(word.encode() + b" "):
        length, code = int(lm_score._BYTE_LENGTH[c]), int(lm_score._BYTE_CODE[c])
        before = int.from_bytes(past[::-1][:7], "little")
        for depth in range(length):
            node, bit = (1 << depth) | code >> (length - depth), code >> (length - depth - 1) & 1
            slots = []
            for k, (keep, salt) in enumerate(((0xFFFF, 1 << 60), (0xFFFFFFFF, 1 << 61), ((1 << 64) - 1, 3 << 60))):
                h = _mask(_mask(_cheap(_mask((before & keep) + salt)) + _mask(node * 0xD6E8FEB86659FD93)) * 0x9E3779B97F4A7C15)
                slots.append((h >> (65 - lm_score._SIZES[6 + k].bit_length())) + BASES[6 + k])
            total -= _loss(_inputs(model, bit, slots), model.weights[lm_score.TEXT_GATES + 8 * min(j, 3) + min(depth, 7)])
        past += bytes([c])
    return total


def _plain(scorer, counts, text, learned):
    """The natural log probability of a text, bit by bit."""
    v, (model, (group, tails), _, _, known, again) = scorer.vocabulary.value, scorer.model.value
    words = SOLID.findall((text or "").translate(LOW))
    keys = [int(x) for x in kernel.text_hashes([text or ""], kernel.NOT_SPACE)[0]] + [END]
    leaf_of = {int(k): n + 2 for n, k in enumerate(v.lookup.keys)}
    w = model.weights[: lm_score.TEXT_GATES].astype(float).copy()
    seen, flags, topic, mark, prev, times, news = collections.Counter(), [0, 0], 0, 0, lm_score.NEAR + 1, 0, 0
    token_ln, bits, moved = [0.0] * len(keys), 0, np.zeros_like(w)

    def code(bit, slots, gate, token, path):
        nonlocal bits, moved
        xs = _inputs(model, bit, slots)
        if path and xs[lm_score.CONTEXTS - 1] != 0:
            gate += 1
        loss = _loss(xs, w[gate])
        token_ln[token] -= loss
        z = sum(a * b for a, b in zip(w[gate], xs, strict=True))
        moved[gate] += lm_score.RATE * np.array(xs) / (1 + math.exp(max(-20.0, min(20.0, z))))
        bits += 1
        if bits % lm_score.STEP == 0:
            w[:] += moved
            moved = np.zeros_like(w)

    rare = []
    for i, key in enumerate(keys):
        end = i == len(keys) - 1
        leaf = 0 if end else leaf_of.get(key, 1)
        new = end or seen[key] == 0
        grade = min(int(math.log2(i + 1)), 15)
        if i:
            code(int(not new), [BASES[3] + 16 * grade + 15 * news // i, BASES[4] + 32 * grade + 16 * flags[1] + 8 * flags[0] + min(times, 7), BASES[5] + 8 * prev + min(grade, 7)], grade, i, False)
        if new:
            length, path = int(v.length[leaf]), int(v.code[leaf])
            for depth in range(length):
                node = (1 << depth) | path >> (length - depth)
                code(path >> (length - depth - 1) & 1, [((grade >> 1) << lm_score.TOP) + node, BASES[1] + (topic << lm_score.TOP) + node, BASES[2] + (prev << lm_score.TOP) + node], lm_score._FLAG_GATES + 2 * depth, i, True)
            token_ln[i] += float(tails[group[mark], leaf])
            if leaf == 1:
                rare.append((i, words[i], key))
        else:
            token_ln[i] += math.log(seen[key] / i)
        times, news = (0 if end else seen[key]), news + new
        seen[key] += 1
        flags = [int(not new), flags[0]]
        topic, mark, prev = int(v.topic[leaf]) or topic, int(v.mark[leaf]) or mark, int(v.near[leaf])
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    for i, word, key in rare:
        d = counts.get((0, signed(key)), (0, 0))[1] - learned
        if d > 0:
            token_ln[i] += math.log(d * (1 - scorer.new) / scorer.d_rest)
        else:
            token_ln[i] += math.log(scorer.new) + _spelled(model, word)
    total, at, before = 0.0, 0, collections.Counter()
    tokens = lm_score.Tokens(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]), None, True)
    for n, (end, key) in enumerate(zip(tokens.phrase_end.tolist(), tokens.phrase_key.tolist(), strict=True)):
        ln = math.log(1 - known - again) + sum(token_ln[at:end])
        if end - at >= lm_score.LEAST_PHRASE:
            if before[key]:
                ln = np.logaddexp(ln, math.log(again * before[key] / n))
            else:
                others = counts.get((1, signed(key)), (0, 0))[0] - learned
                ln = np.logaddexp(ln, math.log(others * known / scorer.n_phrases)) if others > 0 else ln
        before[key] += 1
        total, at = total + ln, end
    return total


def test_score_is_that_of_plain_python(spark):
    texts = [t for t in _texts() if t is None or len(t) < 4000]
    texts += ["the cat and the dog saw a bird in the old tree by the river " * 3, "der hund und die katze sahen den vogel " * 4, *texts[:6]]
    docs = _docs(spark, texts, extra=True)
    scorer = lm_score.train(docs, head=12)
    counts = {(r.kind, r.key): (r.c, r.d) for r in scorer.counts.collect()}
    got = {r.doc_id: r for r in lm_score.scored(docs, scorer).collect()}
    for k, t in enumerate(texts):
        learned = zlib.crc32(str(k).encode()) % 7 != 2
        want = _plain(scorer, counts, t, int(learned))
        assert got[k].score == pytest.approx(want / math.log(10), rel=2e-4, abs=2e-3), k
        assert got[k].bits_per_byte == pytest.approx(-want / math.log(2) / max(len((t or "").encode()), 1), rel=2e-4, abs=2e-3)


@pytest.mark.parametrize("hot", [True, False])
def test_base_counts(spark, monkeypatch, hot):
    if not hot:
        monkeypatch.setattr(lm_score, "HOT", 0)
    texts = [t for t in _texts() for _ in range(3)]
    train = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    own = [[*SOLID.findall((t or "").translate(LOW)), None] for t in texts]
    c = collections.Counter(w for k in train for w in own[k])
    n, v = sum(c.values()), len(c)
    docs = _docs(spark, texts, extra=True)
    for r in lm_score.scored(docs, lm_score.train(docs, head=20)).collect():
        w = own[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, r.doc_id not in train)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.scored(docs, lm_score.train(docs)).collect()
    assert len(got) == 5 and sum(r.held_out for r in got if r.doc_id is None) == 2 and sorted(r.n_tokens for r in got) == [1, 4, 4, 4, 4]


def test_a_copy_is_scored_apart(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(60)]
    docs = _docs(spark, [*texts, *texts[:10]])
    got = {r.doc_id: r.bits_per_byte for r in lm_score.scored(docs, lm_score.train(docs)).collect()}
    learned = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    twice = [got[k] for j in range(10) for k in (j, 60 + j) if learned(60 + j if k == j else j)]
    assert len(twice) > 10 and max(twice) < 0.7 * min(got[k] for k in range(10, 60))


def test_codes_are_probabilities():
    """The tree's leaves, the shares below a node, and the byte code give no more than 1 away."""
    rng = np.random.default_rng(1)
    d = np.sort(rng.integers(2, 900, 499))[::-1]
    v = lm_score.Vocabulary(np.arange(1, 500, dtype=np.uint64), 2 * d, d, 7, 3)
    group, tails = lm_score.grouped_tails(v, rng.integers(0, 5, (lm_score.TOPICS + 1, 501)))
    assert len(tails) == lm_score.GROUPS and set(group.tolist()) == set(range(lm_score.GROUPS))
    for tail in tails:
        assert (0.5 ** v.length.astype(float) * np.exp(tail)).sum() <= 1 + 1e-4
        for node in range(1 << lm_score.TOP):
            below = v.node == node
            assert not below.any() or np.exp(tail[below]).sum() == pytest.approx(1, abs=1e-4)
    assert (0.5 ** lm_score._BYTE_LENGTH.astype(float)).sum() <= 1


def _tokens_of(texts, part=None):
    out = []
    column = pa.array(texts, pa.large_string())
    for a, _, data, offsets, state, ends in lm_score.pieces(column):
        t = lm_score.Tokens(data, offsets, state, ends)
        out.append((a, t, t.new.copy(), t.before.copy(), t.place.copy()))
        if state is not None:
            t.carry(state)
    return out


def test_pieces_of_a_long_text_are_one_text(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["ab", "c", "déf", "x" * 300, "y"], 400)) + "  "
    ((_, whole, *want),) = _tokens_of([text])
    monkeypatch.setattr(lm_score, "PART", 200)
    many = _tokens_of(["short", text, "", text])
    own = [m for m in many if m[0] == 1]
    assert len(own) > 20 and [a for a, *_ in many][:1] == [0]
    assert np.concatenate([t.key for _, t, *_ in own]).tolist() == whole.key.tolist()
    for k in range(3):
        assert np.concatenate([m[2 + k] for m in own]).tolist() == want[k].tolist()


def test_scores_of_pieces(monkeypatch):
    """A long text's pieces, with their state, give the bits that the whole text gives."""
    text = " ".join(np.random.default_rng(4).choice(["the", "cat", "sat", "on", "mats", "zebra9"], 300))
    v = lm_score.Vocabulary(kernel.text_hashes(["the cat sat on"], kernel.NOT_SPACE)[0], np.array([9, 8, 7, 6]), np.array([9, 8, 7, 6]), 5, 3)
    rng = np.random.default_rng(5)
    model = lm_score.Model(rng.integers(0, 9, lm_score.SLOTS), rng.integers(0, 9, lm_score.SLOTS))

    def scored(step):
        monkeypatch.setattr(lm_score, "STEP", step)
        out = []
        for _, _, data, offsets, state, ends in lm_score.pieces(pa.array([text], pa.large_string())):
            t = lm_score.Tokens(data, offsets, state, ends)
            b = lm_score.Bits(v, t, state)
            out.append(model.score(b, state, t.total))
            if state is not None:
                t.carry(state, b)
        return np.concatenate(out)

    whole = scored(1 << 20)
    monkeypatch.setattr(lm_score, "PART", 100)
    monkeypatch.setattr(lm_score, "RATE", 0.0)
    assert np.allclose(scored(64), whole, atol=1e-4)


def test_counts_of_tasks_meet_whole():
    """Blocks of all tasks add up to the bits' counts, above two bytes and 32 bits too, and weights are averaged by bits."""
    texts = ["a b a c d " * 9000, "x yy zzz " * 40, "", "many words of one text here " * 3]
    v = lm_score.Vocabulary(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 3, 60_120)

    class Shared:
        def __init__(self, value):
            self.value = value

    parts = [list(lm_score._learn(Shared(v))([pa.RecordBatch.from_pydict({"text": t})])) for t in (texts, texts[:2])]
    rows = pa.Table.from_batches([b for p in parts for b in p]).sort_by("block")
    total = {}
    for b in lm_score._add_learned(rows.to_batches()):
        total[b.column(0)[0].as_py()] = b.column(1)[0].as_py()
    want = np.zeros(2 * lm_score.SLOTS, np.int64)
    bits = [0, 0]
    for k, own in enumerate((texts, texts[:2])):
        for _, _, data, offsets, state, ends in lm_score.pieces(pa.array(own)):
            t = lm_score.Tokens(data, offsets, state, ends)
            b = lm_score.Bits(v, t, state)
            first, _ = lm_score.rare_words(t, b.leaf)
            for x in [b, *(s for *_, s in lm_score.spelled_blocks(t, first[t.new[first]]))]:
                bits[k] += len(x.bit)
                for slots in x.slots:
                    np.add.at(want, 2 * slots + x.bit, 1)
    got = np.zeros_like(want)
    for k, raw in total.items():
        if 0 <= k < lm_score.SLOTS // lm_score.BLOCK:
            got[2 * k * lm_score.BLOCK : 2 * (k + 1) * lm_score.BLOCK] = np.frombuffer(raw, np.int64)
    assert (got == want).all() and want.sum() == lm_score.CONTEXTS * sum(bits)
    seen = [np.frombuffer(p[0].column(2)[0].as_py(), np.int64).sum() for p in parts]
    assert seen == bits and np.frombuffer(total[-1], np.float32).shape == (lm_score.GATES * (lm_score.CONTEXTS + 1),)
    big = np.zeros(2 * lm_score.BLOCK, np.int64)
    own = np.zeros(2 * lm_score.BLOCK, np.int32)
    own[5] = (1 << 31) - 1
    for _ in range(3):
        lm_score._add_packed(big, *lm_score._packed(own, np.flatnonzero(own)))
    assert big[5] == 3 * ((1 << 31) - 1)


def test_what_is_joined_grows_and_what_travels_does_not(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(4000)]
    make = lambda n: _docs(spark, [" ".join(rng.choice(words, 80)) for _ in range(n)])
    small, large = (lm_score.train(make(n), head=50) for n in (20, 200))
    assert large.counts.count() > 2 * small.counts.count()
    assert len(large.vocabulary.value.lookup.keys) == 50 and len(large.model.value[0].stretch) == len(small.model.value[0].stretch) == lm_score.SLOTS
    assert large.counts.filter(F.col("kind") == 1).count() == 0


def test_a_full_bitmap_changes_no_score(spark):
    """Of a map of phrases that says yes to all, only the look-ups grow."""
    texts = [" ".join(f"w{(k * j) % 37}" for j in range(60)) + f" only{k} " + "one long phrase of several texts " * (k % 3) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = lm_score.train(docs, head=20)
    scores = lambda: {r.doc_id: r.score for r in lm_score.scored(docs, scorer).collect()}
    want = scores()
    model, tails, lookups, bitmap, known, again = scorer.model.value
    scorer.model = spark.sparkContext.broadcast((model, tails, lookups, np.full_like(bitmap, ~np.uint64(0)), known, again))
    got = scores()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)

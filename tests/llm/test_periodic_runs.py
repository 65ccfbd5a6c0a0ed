"""Operator 11 against a plain search of all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(words, min_length=6, min_exponent=4):
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(min_length, min_exponent * q) and not any(words[s : e - r] == words[s + r : e] for r in range(1, q)):
                out.append((s, e - s, q))
            i += i == s
    return sorted(out)


def _digest(words):
    runs = _plain(words)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *own, *(hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), st.integers(1, 9)), max_size=6), st.integers(2, 5))
def test_runs_as_all_periods(parts, exponent):
    texts = [own * n for own, n in parts] + [[w for own, n in parts for w in own * n]]
    found, each, keep = periodic_runs.scan(texts, 2, exponent)
    ends, at = np.cumsum(each), 0
    for k, words in enumerate(texts):
        got = [tuple(x) for x in found[ends[k] - each[k] : ends[k]].tolist()]
        assert got == _plain(words, 2, exponent)
        drop = {j for s, n, q in got for j in range(s + q, s + n)}
        assert keep[at : at + len(words)].tolist() == [j not in drop for j in range(len(words))]
        at += len(words)


def test_wrong_hashes_change_nothing(monkeypatch):
    """With all hashes equal only the words decide."""
    words = [b"a", b"b", b"a", b"c"] * 6 + [b"x"] + [b"y"] * 9 + [b"a", b"b"] * 5 + [b"z"]
    monkeypatch.setattr(periodic_runs.kernel, "mix", lambda h: np.zeros(len(h), np.uint64))
    found, _, _ = periodic_runs.scan([words])
    assert [tuple(x) for x in found.tolist()] == _plain(words)


def test_collapsed(spark):
    texts = ["ha " * 9 + "end", None, "", " \n", "x y " * 4 + "x", "a b c", "ha " * 9 + "end", "é è " * 6, "one\x0btwo\x1cthree " * 8, "w " * 60_000]
    rows = [(k if k != 5 else None, t, k, "s") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, `a.b` string")
    out = periodic_runs.collapsed(docs)
    assert out.columns == ["doc_id", "text", "runs", "a.b", "_runs"] and periodic_runs.collapsed(docs.limit(0)).count() == 0
    got = {r.runs: r for r in out.collect()}
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert [tuple(x) for x in got[k]["_runs"]] == (_plain(words) if len(words) < 1000 else [(0, 60_000, 1)])
    assert got[0].text == "ha end" and got[1].text == "" and got[4].text == "x y" and got[9].text == "w" and got[5].doc_id is None
    with pytest.raises(TypeError):
        periodic_runs.collapsed(docs.selectExpr("doc_id", "cast(text as binary) as text"))


def test_query_as_plain(spark, tmp_path):
    base = [" ".join(f"w{(k * j) % 11}" for j in range(k)) for k in range(70)]
    rows = [(k, t) for k, t in enumerate(base)] + [(3, base[3]), (None, base[40]), (71, None), (72, ""), (73, "la " * 12 + "x " + "la di " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in rows:
        words, h = WORD.findall(t or ""), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append((d, *_digest(words)))
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(w[1] > 0 for w in want) > 8

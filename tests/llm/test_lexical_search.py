"""Operator 12 against a plain scoring of all documents."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import lexical_search

TERM = re.compile(lexical_search.TERM)
LOW = str.maketrans(lexical_search._UPPER, lexical_search._LOWER)


def _terms(text):
    return TERM.findall((text or "").translate(LOW))


def _plain(docs, items, k=10):
    tf = [(d, collections.Counter(_terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        scores = []
        for d, c in tf:
            own = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * own * n // length))) for t in _terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.integers(0, 30), st.integers(0, 5), min_size=1), st.integers(1, 40)), min_size=1, max_size=8), st.integers(1, 4))
def test_best_as_all_scores(parts, k):
    lists, total = [], collections.Counter()
    for own, weight in parts:
        docs = sorted(own)
        gains = [own[d] * weight for d in docs]
        lists.append((docs, gains, max(gains)))
        total.update({d: own[d] * weight for d in docs})
    want = sorted(((s, -d) for d, s in total.items() if s), reverse=True)[:k]
    assert sorted(lexical_search.best(lists, k), reverse=True) == want


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 2**14, 2**35, 2**62], np.int64)
    body, at = lexical_search.packed(values)
    assert lexical_search.unpacked(body).tolist() == values.tolist() and at[-1] == len(body) and at[3] == 3
    assert lexical_search.unpacked(lexical_search.packed(values[:0])[0]).tolist() == []


def _tables(spark, rows, items):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, term string").repartition(3)
    return docs, spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")


@pytest.mark.parametrize(("shard_terms", "block"), [(50, 2), (2_000_000, 1024)])
def test_search_as_plain(spark, shard_terms, block):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 6000) % 90]
    rows = [(int(k) * 3 - 20, " ".join(words[40 * k : 40 * k + int(rng.integers(1, 40))])) for k in range(140)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (5, rows[4][1]), (5, rows[4][1]), (1000, None), (1001, ""), (1002, "--- é É straße W1"), (1003, "rare " * 30_000)]
    items = [(k, " ".join(words[k * 7 : k * 7 + 12])) for k in range(12)] + [(0, " ".join(words[:12])), (20, None), (21, "unknown"), (22, "É straße RARE w1 w1 w1"), (None, "w2 w3"), (23, "w1"), (23, "w2")]
    docs, bench = _tables(spark, rows, items)
    from lattica.llm import common

    postings = common.written(lexical_search.index(docs, shard_terms), "test-postings")
    got = lexical_search.search(postings, bench, query_block=block, broadcast_bytes=lexical_search.BROADCAST_BYTES if block > 2 else 0)
    plain = _plain(rows, items)
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got.collect()) == plain and len(plain) > 120
    assert lexical_search.search(postings, bench.limit(0)).count() == 0
    none = common.written(lexical_search.index(docs.limit(0)), "test-none")
    assert none.count() == 0 and lexical_search.search(none, bench).count() == 0


def test_index_rows():
    data = np.frombuffer(b"B a a b Ab", np.uint8)
    starts, ends = np.array([0, 2, 4, 6, 8]), np.array([1, 3, 5, 7, 10])
    batch = lexical_search._rows(7, [9, None, 2], [(data, starts, ends, np.array([0, 0, 1, 2, 2]), np.array([5, 3, 3, 5, 8], np.uint64))])
    rows = {r["term"]: r for r in batch.to_pylist()}
    numbers = {t: lexical_search.unpacked(np.frombuffer(r["postings"], np.uint8)).tolist() for t, r in rows.items()}
    assert numbers == {None: [2, 4, 7, 2, 2, 1], "a": [1, 1, 1, 1], "b": [0, 1, 1, 1], "ab": [0, 1]}
    assert (rows[None]["df"], rows[None]["n_terms"], rows["b"]["df"]) == (3, 5, 2) and pa.types.is_binary(batch.schema.field("postings").type)


def test_sql(spark, tmp_path):
    rows = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 30))) for k in range(80)]
    items = [(k, f"w{k} w{k + 1} w{k} W3") for k in range(9)]
    for df, name in zip(_tables(spark, rows, items), ("documents", "benchmark"), strict=True):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    rel = con.sql(lexical_search.OP12_SQL)
    got = lexical_search.op12_lexical_search(spark, str(tmp_path))
    assert got.columns == rel.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall())) == _plain(rows, items)

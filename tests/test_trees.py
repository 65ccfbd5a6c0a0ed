"""Trees by given parents, held against a plain walk."""

import random

from pyspark.sql import functions as F

from lattica.operators import order, trees


def _walk(rows, key=lambda c: c):
    """code: (root, depth, descendants, pos, orphan) of rows (code, parent), first rows first."""
    parent = {}
    for c, p in rows:
        parent.setdefault(c, p)
    below, out, at = {}, {}, [0]
    for c, p in parent.items():
        below.setdefault(p if p in parent else None, []).append(c)
    stack = [(c, c, 1) for c in sorted(below.get(None, []), key=key, reverse=True)]
    trail = []
    while stack:
        c, root, depth = stack.pop()
        at[0] += 1
        out[c] = [root, depth, 0, at[0], depth == 1 and bool(parent[c])]
        trail = trail[: depth - 1] + [c]
        for x in trail[:-1]:
            out[x][2] += 1
        stack += [(k, root, depth + 1) for k in sorted(below.get(c, []), key=key, reverse=True)]
    return {c: tuple(out.get(c, (None, None, None, None, False))) for c in parent}


def _nested(spark, rows, **how):
    df = spark.createDataFrame(rows, "code string, parent_code string")
    return trees.nested(df, **how)


def _got(tree):
    return {r.code: (r.root_code, r.depth, r.n_descendants, r.pos, r.is_orphan) for r in tree.collect()}


def test_nested_as_a_walk(spark):
    rng = random.Random(3)
    names = [f"k{x}" for x in rng.sample(range(10_000), 160)]
    rows = [(c, rng.choice([*names[: max(1, k)], "", None, "gone"]) if k % 9 else None) for k, c in enumerate(names)]
    rows = [(c, p) for c, p in rows if c != p]
    rows += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x1"), ("z", "y"), ("self", "self"), ("under", "self")]
    tree = _nested(spark, rows)
    want = _walk(rows)
    assert _got(tree) == want and {r.code for r in trees.cycles(tree).collect()} == {"x1", "x2", "x3", "y", "z", "self", "under"}
    top = max(want, key=lambda c: want[c][2] or 0)
    inside = {r.code for r in trees.subtree(tree, top).collect()}
    assert len(inside) == want[top][2] + 1 > 5 and all(want[c][3] in range(want[top][3], want[top][3] + len(inside)) for c in inside)
    assert trees.subtree(tree, "none").count() == 0 and trees.subtree(tree, "x1").count() == 0
    s = trees.statistics(tree).first()
    assert (s.total_nodes, s.n_cyclic, s.root_nodes) == (len(want), 7, sum(v[1] == 1 for v in want.values()))


def test_a_deep_chain_and_a_hot_parent(spark):
    chain = spark.range(20_000).select(F.col("id").cast("string").alias("code"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_code"))
    got = trees.nested(chain).select(F.col("code").cast("long").alias("k"), "depth", "pos", "n_descendants", "root_code")
    assert got.filter("depth <> k + 1 OR pos <> k + 1 OR n_descendants <> 19999 - k OR root_code <> '0'").isEmpty() and got.count() == 20_000
    star = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("code"), F.when(F.col("id") > 0, F.lit("000000")).alias("parent_code"))
    got = trees.nested(star)
    assert got.filter("pos <> cast(code AS long) + 1 OR n_descendants <> if(code = '000000', 19999, 0)").isEmpty()


def test_ties_orders_and_empty_tables(spark):
    rows = [("a", None, 2), ("a", None, 1), ("a", "b", 0), ("b", "", 5), ("c", "b", 9), ("d", "b", 1), (None, "b", 0), ("c", "b", 9)]
    df = spark.createDataFrame(rows, "code string, parent_code string, seq int")
    got = _got(trees.nested(df, order=("seq",)))
    assert got == {"b": ("b", 1, 3, 1, False), "a": ("b", 2, 0, 2, False), "d": ("b", 2, 0, 3, False), "c": ("b", 2, 0, 4, False)}
    assert trees.nested(df.limit(0)).count() == 0 and trees.statistics(trees.nested(df.limit(0))).first().max_depth == 0


def test_running_sums_of_a_hot_key(spark):
    rows = [(None if k % 3 else "a", f"o{k:05d}", k % 7) for k in range(3000)]
    got = {r.o: r.before for r in order.running(spark.createDataFrame(rows, "k string, o string, v long").repartition(5), ["k"], ["o"], F.col("v")).collect()}
    sums = {}
    for k, o, v in rows:
        assert got[o] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert {r.o: r.before for r in order.running(spark.createDataFrame(rows, "k string, o string, v long"), [], ["o"], F.lit(1)).collect()} == {o: i for i, (_, o, _) in enumerate(rows)}

"""Queries over trees that a column of parents gives, and what DuckDB's recursive CTEs should give for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import trees as T
from lattica.plans import views as W
from lattica.plans.queries import _query


def linked(spark: SparkSession, d: str) -> DataFrame:
    """code, parent_code, name: regions, nations, customers and orders by their keys; some nations are missing."""
    node = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    region = W.table(spark, d, "region").select(node("r", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent_code"), F.col("r_name").alias("name"))
    nation = W.table(spark, d, "nation").filter("n_nationkey % 7 <> 0").select(node("n", "n_nationkey"), node("r", "n_regionkey"), "n_name")
    customer = W.table(spark, d, "customer").select(node("c", "c_custkey"), node("n", "c_nationkey"), "c_name")
    orders = W.table(spark, d, "orders").select(node("o", "o_orderkey"), node("c", "o_custkey"), "o_orderpriority")
    return region.union(nation).union(customer).union(orders)


def deep(spark: SparkSession, d: str) -> DataFrame:
    """code, parent_code: each part below one of the few before it, hundreds of steps deep; of each hundred two are a cycle, with one below."""
    k = F.col("p_partkey")
    up = F.when(k % 100 == 1, k + 1).when((k % 100).isin(2, 3), k - 1).otherwise(k - 1 - k % 5)
    return W.table(spark, d, "part").select(F.lpad(k.cast("string"), 12, "0").alias("code"), F.lpad(up.cast("string"), 12, "0").alias("parent_code"))


_LINKED = """e AS (SELECT 'r' || r_regionkey AS code, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation WHERE n_nationkey % 7 <> 0
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority FROM orders)"""
_DEEP = "e AS (SELECT lpad(cast(p_partkey AS VARCHAR), 12, '0') AS code, lpad(cast(CASE WHEN p_partkey % 100 = 1 THEN p_partkey + 1 WHEN p_partkey % 100 IN (2, 3) THEN p_partkey - 1 ELSE p_partkey - 1 - p_partkey % 5 END AS VARCHAR), 12, '0') AS parent, '' AS name FROM part)"


def _nested(edges: str) -> str:
    return f"""WITH RECURSIVE {edges},
base AS (SELECT e.code, e.name, p.code AS up, e.parent IS NOT NULL AND p.code IS NULL AS is_orphan FROM e LEFT JOIN e p ON e.parent = p.code),
walk AS (SELECT code, code AS root_code, 1 AS depth, [name || chr(1) || code] AS trail, [code] AS path FROM base WHERE up IS NULL
  UNION ALL SELECT b.code, w.root_code, w.depth + 1, list_append(w.trail, b.name || chr(1) || b.code), list_append(w.path, b.code) FROM walk w JOIN base b ON b.up = w.code),
below AS (SELECT c AS code, count(*) - 1 AS n FROM (SELECT unnest(path) AS c FROM walk) GROUP BY c),
tree AS (SELECT b.code, w.root_code, cast(w.depth AS INTEGER) AS depth, l.n AS n_descendants, w.pos, b.is_orphan
  FROM base b LEFT JOIN (SELECT *, row_number() OVER (ORDER BY trail) AS pos FROM walk) w USING (code) LEFT JOIN below l USING (code))"""


def _tree(spark, d):
    return T.nested(linked(spark, d), order=("name",))


@_query("hr02_given_parents", f"{_nested(_LINKED)} SELECT * FROM tree")
def _(spark, d):
    return _tree(spark, d).select("code", "root_code", "depth", "n_descendants", "pos", "is_orphan")


@_query("hr06_deep_parents", f"{_nested(_DEEP)} SELECT * FROM tree")
def _(spark, d):
    return T.nested(deep(spark, d)).select("code", "root_code", "depth", "n_descendants", "pos", "is_orphan")


@_query("ag03_given_statistics", f"{_nested(_LINKED)} SELECT count(*) AS total_nodes, count(CASE WHEN depth = 1 THEN 1 END) AS root_nodes, count(CASE WHEN is_orphan THEN 1 END) AS n_orphans, count(CASE WHEN n_descendants = 0 THEN 1 END) AS n_leaves, count(*) - count(pos) AS n_cyclic, max(depth) AS max_depth FROM tree")
def _(spark, d):
    return T.statistics(_tree(spark, d))


@_query("ag04_given_levels", f"{_nested(_DEEP)} SELECT depth, count(*) AS n_nodes, count(CASE WHEN n_descendants = 0 THEN 1 END) AS n_leaves, avg(n_descendants) AS avg_descendants FROM tree WHERE pos IS NOT NULL GROUP BY depth")
def _(spark, d):
    return T.levels(T.nested(deep(spark, d)))


@_query("hr03_given_subtree", f"{_nested(_LINKED)} SELECT t.code, t.depth, t.pos FROM tree t JOIN tree a ON a.code = 'n3' WHERE t.pos BETWEEN a.pos AND a.pos + a.n_descendants")
def _(spark, d):
    return T.subtree(_tree(spark, d), "n3").select("code", "depth", "pos")


@_query("jn06_given_roots", f"{_nested(_LINKED)} SELECT code, n_descendants, is_orphan FROM tree WHERE depth = 1")
def _(spark, d):
    return T.roots(_tree(spark, d)).select("code", "n_descendants", "is_orphan")


@_query("hr08_cycles", f"{_nested(_DEEP)} SELECT code FROM tree WHERE pos IS NULL")
def _(spark, d):
    return T.cycles(T.nested(deep(spark, d))).select("code")

"""A query for each group of operators over the driver's tables, and what DuckDB should give for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import codes, text
from lattica.operators import blocks as B
from lattica.operators import hierarchy as H
from lattica.operators import metrics as M
from lattica.operators import reconcile as R
from lattica.operators import sheets as S
from lattica.operators import versions as V
from lattica.plans import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TAX, _ORPHANS = f"WITH {W.tax_sql()}", f"WITH {W.tax_sql(True)}"
_TREE = f"{_ORPHANS}, tree AS (SELECT t.*, {W.LEVEL_SQL.replace('CASE parts', 'CASE t.parts')} AS level, t.parent <> '' AND p.code IS NULL AS is_orphan, CASE WHEN p.code IS NULL THEN '' ELSE t.parent END AS tree_parent FROM tax t LEFT JOIN tax p ON t.parent = p.code)"
# An orphan customer is a root; its orders are below it.
_DEPTH = f"{_TREE}, deep AS (SELECT t.*, CASE WHEN t.tree_parent = '' THEN t.code WHEN t.parts = 2 THEN string_split(t.code, '-')[1] WHEN t.parts = 3 THEN string_split(t.code, '-')[1] WHEN p.is_orphan THEN t.parent ELSE string_split(t.code, '-')[1] END AS root_code FROM tree t LEFT JOIN tree p ON t.parent = p.code), depths AS (SELECT *, parts - len(string_split(root_code, '-')) + 1 AS depth FROM deep)"


def _tree(spark, d):
    return H.built(W.tax(spark, d, orphans=True))


@_query("hr01_build_hierarchy", f"{_TREE} SELECT code, name, level, tree_parent, is_orphan FROM tree")
def _(spark, d):
    return _tree(spark, d)


@_query("hr01_build_drop_orphans", f"{_TREE} SELECT code, name, level, tree_parent FROM tree t WHERE NOT is_orphan AND NOT (parts = 4 AND parent IN (SELECT code FROM tree WHERE is_orphan))")
def _(spark, d):
    return H.built(W.tax(spark, d, orphans=True), "drop").drop("is_orphan")


@_query("ag03_tree_statistics", f"{_DEPTH} SELECT count(*) AS n_nodes, cast(max(depth) AS INTEGER) AS max_depth, count(CASE WHEN tree_parent = '' THEN 1 END) AS n_roots, count(CASE WHEN parts = 1 THEN 1 END) AS n_level_0, count(CASE WHEN parts = 2 THEN 1 END) AS n_level_1, count(CASE WHEN parts = 3 THEN 1 END) AS n_level_2, count(CASE WHEN parts = 4 THEN 1 END) AS n_level_3 FROM depths")
def _(spark, d):
    return H.statistics(_tree(spark, d))


@_query("hr02_flatten_preorder", f"{_DEPTH} SELECT code, root_code, cast(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY root_code, code) AS pos FROM depths")
def _(spark, d):
    return H.preorder(_tree(spark, d)).select("code", "root_code", "depth", "pos")


@_query("hr03_find_descendants", f"{_TAX} SELECT code, name FROM tax WHERE code = '2-11' OR starts_with(code, '2-11-')")
def _(spark, d):
    return H.subtree(W.tax(spark, d), "2-11").select("code", "name")


@_query("hr04_find_children", f"{_TAX} SELECT code, name FROM tax WHERE parent = '1'")
def _(spark, d):
    return H.children(W.tax(spark, d), "1").select("code", "name")


@_query("hr05_leaves", f"{_TREE} SELECT code FROM tree WHERE code NOT IN (SELECT tree_parent FROM tree)")
def _(spark, d):
    return H.leaves(_tree(spark, d)).select("code")


@_query("hr06_depth", f"{_DEPTH} SELECT depth::INTEGER AS depth, count(*) AS n FROM depths GROUP BY 1")
def _(spark, d):
    return H.with_depth(_tree(spark, d)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@_query("hr07_sorted_children", f"{_TREE} SELECT tree_parent AS code, string_agg(code, ',' ORDER BY code) AS children FROM tree WHERE tree_parent <> '' GROUP BY 1")
def _(spark, d):
    return H.sorted_children(_tree(spark, d)).withColumn("children", F.array_join("children", ","))


@_query("hr10_merge_first", f"{_TAX} SELECT code, name FROM tax UNION ALL SELECT 'x' || code, name FROM tax WHERE parts = 2")
def _(spark, d):
    rows = W.tax(spark, d).select("code", "name")
    other = rows.filter(codes.dashes(F.col("code")) == 1)
    other = other.unionByName(other.withColumn("code", F.concat(F.lit("x"), "code")))
    return H.merged(rows, other.withColumn("name", F.when(F.startswith("code", F.lit("x")), F.col("name")).otherwise("other")))


@_query("hr10_merge_overwrite", f"{_TAX} SELECT code, CASE WHEN parts = 2 THEN 'other' ELSE name END AS name FROM tax")
def _(spark, d):
    rows = W.tax(spark, d).select("code", "name")
    return H.merged(rows, rows.filter(codes.dashes(F.col("code")) == 1).withColumn("name", F.lit("other")), conflict="overwrite")


@_query("hr10_pruned", f"{_DEPTH}, gone AS (SELECT code FROM depths WHERE is_orphan OR code = '2-11' OR depth > 3) SELECT code, name FROM depths d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.code = d.code OR starts_with(d.code, g.code || '-'))")
def _(spark, d):
    return H.pruned(_tree(spark, d), max_depth=3, orphans=True, keep=F.col("code") != "2-11").select("code", "name")


@_query("hr13_split_by_size", f"{_TAX} SELECT part, count(*) AS n FROM (SELECT cast((row_number() OVER (ORDER BY seq) - 1) // 1000 AS VARCHAR) AS part FROM tax) GROUP BY 1")
def _(spark, d):
    return H.split_up(W.tax(spark, d), "size", 1000).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_query("hr13_split_by_level", f"{_TAX} SELECT cast(parts - 1 AS VARCHAR) AS part, count(*) AS n FROM tax GROUP BY 1")
def _(spark, d):
    return H.split_up(W.tax(spark, d), "level").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_query("ag27_tree_statistics", f"""{_DEPTH}, k AS (SELECT tree_parent, count(*) AS n FROM tree WHERE tree_parent <> '' GROUP BY 1) SELECT count(*) AS n_nodes, count(CASE WHEN k.n IS NULL THEN 1 END) AS n_leaves, cast(max(depth) AS INTEGER) AS max_depth, avg(depth) AS avg_depth,
  max(k.n) AS max_children, avg(k.n) AS avg_children, count(CASE WHEN is_orphan THEN 1 END) AS n_orphans FROM depths LEFT JOIN k ON code = k.tree_parent""")
def _(spark, d):
    return H.tree_statistics(_tree(spark, d))


@_query("hr13_intersection", f"{_TAX} SELECT code, name FROM tax WHERE parts = 2")
def _(spark, d):
    rows = W.tax(spark, d).select("code", "name")
    return H.merged(rows, rows.filter(codes.dashes(F.col("code")) == 1), "intersection")


@_query("hr14_missing_parents", f"{_ORPHANS} SELECT DISTINCT parent AS code FROM tax WHERE parts = 3 AND parent NOT IN (SELECT code FROM tax)")
def _(spark, d):
    return H.missing_parents(W.tax(spark, d, orphans=True))


@_query("hr14_limited", f"{_DEPTH}, k AS (SELECT *, row_number() OVER (PARTITION BY tree_parent ORDER BY code) AS k FROM depths WHERE depth <= 3) SELECT code, cast(depth AS INTEGER) AS depth FROM k WHERE k <= 5 OR tree_parent = ''")
def _(spark, d):
    return H.limited(_tree(spark, d), 3, 5).select("code", "depth")


@_query("ag04_descendants_count", f"{_TAX} SELECT a.code, count(*) AS n_descendants FROM tax a JOIN tax b ON a.parts <= 3 AND starts_with(b.code, a.code || '-') GROUP BY a.code")
def _(spark, d):
    return H.descendants_count(W.tax(spark, d))


@_query("ag05_children_count", f"{_TREE} SELECT tree_parent AS code, count(*) AS n_children FROM tree WHERE tree_parent <> '' GROUP BY 1")
def _(spark, d):
    return H.children_count(_tree(spark, d))


@_query("jn04_parent_name", f"{_TAX} SELECT t.code, t.name, p.name AS parent_name FROM tax t LEFT JOIN tax p ON t.parent = p.code")
def _(spark, d):
    return H.with_parent_name(W.tax(spark, d)).select("code", "name", "parent_name")


@_query("jn05_has_children", f"{_TAX} SELECT code, code IN (SELECT parent FROM tax) AS has_children FROM tax")
def _(spark, d):
    return H.with_has_children(W.tax(spark, d)).select("code", "has_children")


@_query("jn06_roots", f"{_ORPHANS} SELECT code, name FROM tax WHERE parent NOT IN (SELECT code FROM tax)")
def _(spark, d):
    return H.roots(W.tax(spark, d, orphans=True)).select("code", "name")


@_query("wn01_first_wins", "SELECT o_orderpriority AS code, o_orderkey AS seq, o_custkey AS owner FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 1")
def _(spark, d):
    return H.first_wins(W.table(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("owner")))


@_query("wn02_last_wins", "SELECT o_custkey AS code, o_orderkey AS seq, o_orderpriority AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(spark, d):
    return H.last_wins(W.table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name")))


_BAD = "bad AS (SELECT seq, CASE seq % 7 WHEN 1 THEN code || '!' WHEN 2 THEN '-' || code WHEN 3 THEN code || '-' WHEN 4 THEN '' ELSE code END AS code, CASE WHEN seq % 5 = 0 THEN '' ELSE name END AS name FROM tax)"


def _bad(spark, d):
    k = F.col("seq") % 7
    code = F.when(k == 1, F.concat("code", F.lit("!"))).when(k == 2, F.concat(F.lit("-"), "code")).when(k == 3, F.concat("code", F.lit("-"))).when(k == 4, "").otherwise(F.col("code"))
    return W.tax(spark, d).select("seq", code.alias("code"), F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("name")).alias("name"))


_DASHES = "(length(code) - length(replace(code, '-', '')))"


@_query("fn08_16_code_functions", f"""{_TAX}, {_BAD} SELECT seq, CASE {_DASHES} WHEN 0 THEN '大类' WHEN 1 THEN '中类' WHEN 2 THEN '小类' WHEN 3 THEN '细类' ELSE '未知级别' END AS level_of,
  CASE {_DASHES} WHEN 0 THEN '大类' WHEN 1 THEN '中类' WHEN 2 THEN '小类' WHEN 3 THEN '细类' ELSE '未知层级' END AS level_name, CASE {_DASHES} WHEN 0 THEN '大类' WHEN 1 THEN '中类' WHEN 2 THEN '小类' ELSE '细类' END AS by_parts,
  CASE {_DASHES} WHEN 0 THEN '大类' WHEN 1 THEN '中类' WHEN 2 THEN '小类' ELSE '' END AS skeleton, CASE WHEN code = '' THEN -1 ELSE {_DASHES} END::INTEGER AS level_int, regexp_extract(code, '^(.*)-[^-]*$', 1) AS parent_code,
  string_split(code, '-')[1] AS main_category, regexp_matches(code, '^[0-9]+(-[0-9]+)*$') AS is_valid, regexp_matches(code, '^1-05-[0-9]+$') AS is_detail FROM bad""")
def _(spark, d):
    c = F.col("code")
    return _bad(spark, d).select("seq", codes.level_of(c).alias("level_of"), codes.level_name(codes.dashes(c)).alias("level_name"), codes.level_of_parts(c).alias("by_parts"), codes.level_of_skeleton(c).alias("skeleton"), codes.level_int(c).cast("int").alias("level_int"), codes.parent_code(c).alias("parent_code"), codes.main_category(c).alias("main_category"), codes.is_valid_code(c).alias("is_valid"), codes.is_detail_of(c, F.lit("1-05")).alias("is_detail"))


@_query("flt15_validation_errors", f"""{_TAX}, {_BAD} SELECT code, error, count(*) AS n FROM (SELECT code, unnest([CASE WHEN code = '' THEN 'code:required' END, CASE WHEN name = '' THEN 'name:required' END, CASE WHEN {_DASHES} > 3 THEN 'level:enum' END,
  CASE WHEN NOT regexp_matches(code, '^[0-9]+(-[0-9]+)*$') THEN 'code:format' END]) AS error FROM bad) WHERE error IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return H.validated(_bad(spark, d).withColumn("level", codes.level_of(F.col("code")))).groupBy("code", "error").agg(F.count(F.lit(1)).alias("n"))


@_query("flt04_valid_records", f"{_TAX}, {_BAD} SELECT code FROM bad WHERE code <> '' AND name <> '' AND {_DASHES} BETWEEN 0 AND 3")
def _(spark, d):
    return _bad(spark, d).filter(codes.is_valid_record(F.col("code"), F.col("name"), codes.level_int(F.col("code")))).select("code")


@_query("fn01_normalize_name", f"WITH {W.MESSY_SQL} SELECT key, n_name || ' 技术员 x ' || n_name AS name FROM messy")
def _(spark, d):
    return W.messy(spark, d).select("key", text.normalized_name(F.col("raw")).alias("name"))


@_query("fn03_parse_cell", f"WITH {W.CELLS_SQL} SELECT row_idx, cast(row_idx % 8 + 1 AS VARCHAR) AS code, cast(row_idx * 10 AS VARCHAR) AS gbm_code, 'Part tail 2' AS name FROM cells WHERE NOT junk")
def _(spark, d):
    return W.cells(spark, d).select("row_idx", text.parsed_cell(F.get("cells", F.lit(0))).alias("p")).filter("p is not null").select("row_idx", "p.*")


@_query("fn05_skeleton_records", f"""WITH {W.CELLS_SQL}, t AS (SELECT row_idx, row_idx % 8 + 1 AS k FROM cells WHERE NOT junk)
SELECT row_idx, 0 AS pos, cast(k AS VARCHAR) AS code, cast(row_idx * 10 AS VARCHAR) AS gbm_code, 'tail' AS name FROM t UNION ALL SELECT row_idx, 1, '2', '', '' FROM t
UNION ALL SELECT row_idx, 2, k || '-' || lpad(cast(row_idx % 100 AS VARCHAR), 2, '0'), '', 'name' FROM t""")
def _(spark, d):
    return S.skeleton_records(W.cells(spark, d))


@_query("flt01_junk_rows", f"WITH {W.CELLS_SQL} SELECT row_idx, junk FROM cells")
def _(spark, d):
    return W.cells(spark, d).select("row_idx", S.is_junk(F.col("cells")).alias("junk"))


@_query("gn01_detail_pairs", f"""WITH {W.CELLS_SQL}, l AS (SELECT row_idx, string_split(e, chr(10)) AS c, string_split(f, chr(10)) AS m FROM cells WHERE NOT junk AND n > 5 AND e <> '' AND f <> '')
SELECT row_idx, cast(i AS INTEGER) - 1 AS pos, c[i] AS code, trim(m[i]) AS name FROM l, unnest(range(1, least(len(c), len(m)) + 1)) AS u(i)""")
def _(spark, d):
    return S.detail_records(W.cells(spark, d))


@_query("gn02_detail_of_small", f"""WITH {W.CELLS_SQL}, l AS (SELECT row_idx, string_split(e, chr(10)) AS c, string_split(f, chr(10)) AS m FROM cells WHERE n > 5 AND e <> '' AND f <> '' AND NOT (row_idx % 90) IN (3, 4))
SELECT '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0') AS small, row_idx, cast(i AS INTEGER) - 1 AS pos, c[i] AS code, trim(m[i]) AS name FROM l, unnest(range(1, least(len(c), len(m)) + 1)) AS u(i)""")
def _(spark, d):
    smalls = spark.range(90).filter(~F.col("id").isin(3, 4)).select(F.concat(F.lit("1-01-"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("code"))
    return S.detail_records_of(W.cells(spark, d), smalls)


@_query("gn03_04_skeleton_cells", f"WITH {W.CELLS_SQL} SELECT row_idx, CASE WHEN n = 6 THEN a || ' ' || b || '  ' ELSE a || ' ' || b || ' ' END AS joined, cast(least(n, 4) AS INTEGER) AS n_cells FROM cells")
def _(spark, d):
    cells = W.cells(spark, d)
    return cells.select("row_idx", S.skeleton_text(F.col("cells")).alias("joined")).join(S.skeleton_cells(cells).groupBy("row_idx").agg(F.count(F.lit(1)).cast("int").alias("n_cells")), "row_idx")


@_query("ag24_parse_stats", f"""WITH {W.CELLS_SQL}, l AS (SELECT len(string_split(e, chr(10))) AS c, len(string_split(f, chr(10))) AS m FROM cells WHERE NOT junk AND n > 5 AND e <> '' AND f <> '')
SELECT 0 AS source, 3 * count(*) AS n_records FROM cells WHERE NOT junk UNION ALL SELECT 1, cast(sum(least(c, m)) AS BIGINT) FROM l""")
def _(spark, d):
    return S.records(W.cells(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"))


# Each cell that is not junk names the class "k-nn" in its second column; rows divisible by 3 name a major and a small class too.
_HYBRID = f"""WITH {W.CELLS_SQL}, l AS (SELECT row_idx, string_split(e, chr(10)) AS c, string_split(f, chr(10)) AS m FROM cells WHERE n > 5 AND e <> '' AND f <> ''),
found AS (SELECT '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0') AS small, row_idx, cast(i AS INTEGER) - 1 AS pos, c[i] AS code, trim(m[i]) AS name FROM l, unnest(range(1, least(len(c), len(m)) + 1)) AS u(i)),
smalls AS (SELECT '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0') AS code, count(*) AS n FROM cells WHERE NOT junk AND row_idx % 3 = 0 GROUP BY 1)"""


def _hybrid_cells(spark, d):
    k = F.col("row_idx")
    third = F.when(k % 3 == 0, F.concat(F.lit("第三大类 3 (GBM 300) 生产 人员")))
    fourth = F.when(k % 3 == 0, F.concat(F.lit("1-01-"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit(" (GBM 7) 小 类")))
    cells = F.concat(F.slice("cells", 1, 2), F.array(F.coalesce(third, F.lit("")), F.coalesce(fourth, F.lit(""))), F.slice("cells", 5, 2))
    return W.cells(spark, d).select("row_idx", F.when(F.size("cells") > 5, cells).otherwise(F.col("cells")).alias("cells"))


@_query("src02_hybrid_scan", f"""{_HYBRID}, s AS (SELECT code FROM smalls WHERE EXISTS (SELECT 1 FROM cells WHERE NOT junk AND row_idx % 3 = 0 AND n > 5 AND '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0') = smalls.code))
SELECT 'rows' AS what, count(*) AS n FROM cells UNION ALL SELECT 'skeleton', count(*) + 2 * count(CASE WHEN row_idx % 3 = 0 AND n > 5 THEN 1 END) FROM cells WHERE NOT junk UNION ALL SELECT 'tasks', count(DISTINCT small) FROM found WHERE small IN (SELECT code FROM s)""")
def _(spark, d):
    return S.hybrid(_hybrid_cells(spark, d))[2]


@_query("st03_fn06_07_skeleton_cells", f"""WITH {W.CELLS_SQL}, t AS (SELECT * FROM cells WHERE NOT junk)
SELECT row_idx, 1 AS col, (row_idx % 8 + 1) || '-' || lpad(cast(row_idx % 100 AS VARCHAR), 2, '0') AS code, 0::BIGINT AS gbm, 'name' AS name, '中类' AS level FROM t
UNION ALL SELECT row_idx, 2, '3', 300, '生产人员', '大类' FROM t WHERE row_idx % 3 = 0 AND n > 5 UNION ALL SELECT row_idx, 3, '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0'), 7, '小类', '小类' FROM t WHERE row_idx % 3 = 0 AND n > 5""")
def _(spark, d):
    return S.skeleton_of_cells(_hybrid_cells(spark, d)).drop("pos")


@_query("ag23_task_packs", f"""{_HYBRID} SELECT small AS parent_code, '小类' AS parent_name, string_agg(code, ',' ORDER BY row_idx, pos) AS codes, string_agg(name, ',' ORDER BY row_idx, pos) AS names FROM found
WHERE small IN (SELECT '1-01-' || lpad(cast(row_idx % 90 AS VARCHAR), 2, '0') FROM cells WHERE NOT junk AND row_idx % 3 = 0 AND n > 5) GROUP BY 1""")
def _(spark, d):
    return S.hybrid(_hybrid_cells(spark, d))[1].withColumns({c: F.array_join(c, ",") for c in ("codes", "names")})


@_query("gn07_row_pairs", f"""WITH {W.CELLS_SQL}, l AS (SELECT row_idx, string_split(e, chr(10)) AS c, string_split(f, chr(10)) AS m FROM cells WHERE n > 5 AND e <> '' AND f <> '')
SELECT row_idx, cast(i AS INTEGER) - 1 AS pos, c[i] AS code, trim(m[i]) AS name FROM l, unnest(range(1, least(len(c), len(m)) + 1)) AS u(i)""")
def _(spark, d):
    return S.row_pairs(W.cells(spark, d))


@_query("fn04_parse_cell_hybrid", f"WITH {W.CELLS_SQL} SELECT row_idx, cast(row_idx % 8 + 1 AS VARCHAR) AS code, cast(row_idx * 10 AS VARCHAR) AS gbm_code, 'Parttail 2' AS name FROM cells WHERE NOT junk")
def _(spark, d):
    return W.cells(spark, d).select("row_idx", text.parsed_cell(F.get("cells", F.lit(0)), "").alias("p")).filter("p is not null").select("row_idx", "p.*")


_V = f"WITH {W.VERSIONS_SQL}"


@_query("ag01_version_history", f"{_V} SELECT task_id, batch_id, is_current, count(*) AS n_rows FROM v GROUP BY ALL")
def _(spark, d):
    return V.history(W.versions(spark, d)).drop("batch_ts")


@_query("tk08_latest_complete", f"{_V} SELECT task_id, max(batch_id) AS batch_id FROM (SELECT task_id, batch_id FROM v GROUP BY ALL HAVING count(*) > 40) GROUP BY task_id")
def _(spark, d):
    return V.latest_complete(W.versions(spark, d), 40)


@_query("jn11_resolved_version", f"""{_V}, best AS (SELECT task_id, max(batch_id) AS b FROM (SELECT task_id, batch_id FROM v GROUP BY ALL HAVING count(*) > 45) GROUP BY task_id)
SELECT task_id, code, batch_id FROM v LEFT JOIN best USING (task_id) WHERE CASE WHEN b IS NOT NULL THEN batch_id = b ELSE is_current END""")
def _(spark, d):
    return V.resolved(W.versions(spark, d), 45).select("task_id", "code", "batch_id")


@_query("flt05_current_version", f"{_V} SELECT code, name FROM v WHERE task_id = 7 AND is_current")
def _(spark, d):
    return V.current(W.versions(spark, d), 7).select("code", "name")


@_query("flt06_by_batch", f"{_V} SELECT task_id, code FROM v WHERE batch_id = 1995")
def _(spark, d):
    return V.by_batch(W.versions(spark, d), 1995).select("task_id", "code")


@_query("flt07_children_of", f"{_V} SELECT task_id, code FROM v WHERE parent_code = '1-05' AND is_current")
def _(spark, d):
    return V.children_of(W.versions(spark, d), "1-05").select("task_id", "code")


@_query("snk02_versioned_insert", f"{_V} SELECT task_id, batch_id, is_current AND task_id % 2 = 1 AS is_current, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT task_id, 2100, true, count(*) FROM v WHERE task_id % 2 = 0 AND is_current GROUP BY ALL")
def _(spark, d):
    rows = W.versions(spark, d)
    new = rows.filter("task_id % 2 = 0 and is_current").withColumn("batch_id", F.lit(2100))
    return V.inserted(rows, new).groupBy("task_id", "batch_id", "is_current").agg(F.count(F.lit(1)).alias("n"))


@_query("snk03_replace_by_task", f"{_V} SELECT task_id, count(*) AS n FROM v WHERE task_id >= 10 OR is_current GROUP BY task_id")
def _(spark, d):
    rows = W.versions(spark, d)
    return V.replaced(rows, rows.filter("task_id < 10 and is_current")).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


@_query("snk04_update_by_code", f"{_V} SELECT task_id, code, CASE WHEN task_id = 3 AND is_current THEN 'done' ELSE status END AS status FROM v")
def _(spark, d):
    rows = W.versions(spark, d)
    return V.updated(rows, rows.filter("task_id = 3 and is_current").select("task_id", "code", F.lit("done").alias("status")), ["status"]).select("task_id", "code", "status")


@_query("ag02_status_distribution", f"{_V} SELECT status, count(*) AS n FROM v GROUP BY status")
def _(spark, d):
    return V.status_distribution(W.versions(spark, d))


@_query("tk01_tasks_page", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return V.page(W.table(spark, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 20, 40).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_B = f"WITH {W.BLOCKS_SQL}"


def _blocks(spark, d):
    return B.derived(W.blocks(spark, d))


@_query("fn18_block_columns", f"{_B} SELECT task_id, page_num, block_num, 100.0::DOUBLE AS width, 10.0::DOUBLE AS height, (x0 + 50)::DOUBLE AS center_x, yc::DOUBLE AS center_y, is_bold, is_italic, code AS occupation_code FROM blocks")
def _(spark, d):
    return _blocks(spark, d).select("task_id", "page_num", "block_num", "width", "height", "center_x", "center_y", "is_bold", "is_italic", "occupation_code")


@_query("jn08_code_name_match", f"""{_B}, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY page_num, block_num) AS r, regexp_matches(text, '员|师|工|长|家|人员|技术|管理|操作|专员|主管') AND NOT regexp_matches(text, '^[0-9\\s.-]+$') AS named FROM blocks),
c AS (SELECT a.task_id, a.page_num, a.block_num, b.r, b.text, CASE WHEN abs(b.yc - a.yc) < 10 THEN CASE WHEN b.named THEN 0.9 END WHEN b.yc > a.yc AND b.yc - a.yc < 20 AND b.named THEN 0.7 END::DOUBLE AS s FROM o a JOIN o b ON a.task_id = b.task_id AND b.r BETWEEN a.r + 1 AND a.r + 4 WHERE a.code IS NOT NULL),
h AS (SELECT * FROM c WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id, page_num, block_num ORDER BY r) = 1)
SELECT o.task_id, o.page_num, o.block_num, o.code AS occupation_code, h.text AS occupation_name, h.s AS confidence FROM o LEFT JOIN h USING (task_id, page_num, block_num) WHERE o.code IS NOT NULL""")
def _(spark, d):
    return B.matched(_blocks(spark, d)).select("task_id", "page_num", "block_num", "occupation_code", "occupation_name", "confidence")


_LEVELS = f"""{_B}, z AS (SELECT task_id, list(DISTINCT font_size ORDER BY font_size DESC)[1:3] AS sizes FROM blocks GROUP BY task_id), i0 AS (SELECT task_id, list(DISTINCT x0 ORDER BY x0) AS xs FROM blocks WHERE x0 > 0 GROUP BY task_id),
i AS (SELECT task_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 15 THEN list_concat(a, x) ELSE a END)[1:4] AS lv FROM i0),
l1 AS (SELECT b.*, CASE WHEN font_size >= sizes[1] THEN 1 WHEN font_size >= sizes[2] THEN 2 WHEN font_size >= sizes[3] THEN 3 ELSE 4 END AS bs, list_position(list_transform(lv, lambda x: abs(b.x0 - x) < 10), true) AS near, lv FROM blocks b LEFT JOIN z USING (task_id) LEFT JOIN i USING (task_id)),
l2 AS (SELECT *, least(bs + CASE WHEN lv IS NULL THEN 0 WHEN near > 0 THEN near - 1 WHEN x0 > lv[-1] THEN len(lv) ELSE 0 END, 4) AS l FROM l1),
lev AS (SELECT *, cast(CASE WHEN is_bold AND l > 1 THEN l - 1 ELSE l END AS INTEGER) AS hierarchy_level FROM l2)"""


@_query("wn16_hierarchy_level", f"{_LEVELS} SELECT task_id, page_num, block_num, hierarchy_level FROM lev")
def _(spark, d):
    return B.with_levels(_blocks(spark, d)).select("task_id", "page_num", "block_num", "hierarchy_level")


@_query("ag07_level_distribution", f"{_LEVELS} SELECT cast(g AS INTEGER) AS hierarchy_level, count(task_id) AS n_blocks FROM range(1, 5) AS t(g) LEFT JOIN lev ON hierarchy_level = g GROUP BY g")
def _(spark, d):
    return B.level_distribution(B.with_levels(_blocks(spark, d)))


@_query("tk06_first_three", f"{_LEVELS} SELECT task_id, hierarchy_level AS level, cast(k AS INTEGER) AS k, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY task_id, hierarchy_level ORDER BY page_num, block_num) AS k FROM lev) WHERE k <= 3")
def _(spark, d):
    return B.examples(B.with_levels(_blocks(spark, d)))


@_query("ag06_08_block_summary", f"{_B} SELECT task_id, count(*) AS n_blocks, count(DISTINCT page_num) AS n_pages, count(code) AS n_code_blocks, count(DISTINCT code) AS n_codes, count(DISTINCT font) AS n_fonts FROM blocks GROUP BY task_id")
def _(spark, d):
    return B.summary(_blocks(spark, d))


@_query("tk07_fonts", f"{_B} SELECT font, font_size::DOUBLE AS font_size, count(*) AS n_blocks FROM blocks GROUP BY ALL ORDER BY n_blocks DESC, font, font_size LIMIT 10")
def _(spark, d):
    return B.fonts(W.blocks(spark, d))


@_query("ag09_layout_analysis", f"""{_B} SELECT task_id, min(font_size)::DOUBLE AS min_size, max(font_size)::DOUBLE AS max_size, count(DISTINCT page_num) AS n_pages, cast(count(DISTINCT CASE WHEN x0 > 0 THEN x0 END) AS INTEGER) AS n_indents,
  coalesce(array_to_string(list_transform(list(DISTINCT x0 ORDER BY x0) FILTER (x0 > 0), lambda x: x || '.0')[1:5], ','), '') AS top_indents FROM blocks GROUP BY task_id""")
def _(spark, d):
    return B.layout(_blocks(spark, d))


@_query("ag11_page_fonts", f"""{_B}, f AS (SELECT task_id, page_num, font, count(*) AS n FROM blocks GROUP BY ALL), s AS (SELECT task_id, page_num, count(DISTINCT font_size) AS n_sizes, count(*) AS n_blocks FROM blocks GROUP BY ALL)
SELECT task_id, page_num, font AS primary_font, n_blocks, n_sizes FROM f JOIN s USING (task_id, page_num) QUALIFY row_number() OVER (PARTITION BY task_id, page_num ORDER BY n DESC, font) = 1""")
def _(spark, d):
    return B.page_fonts(W.blocks(spark, d))


@_query("wn08_09_page_layout", f"""{_B}, g AS (SELECT task_id, page_num, x0 - lag(x0) OVER (PARTITION BY task_id, page_num ORDER BY x0, block_num) AS gap FROM blocks WHERE y0 > 84.2 AND y0 < 757.8),
gs AS (SELECT task_id, page_num, count(CASE WHEN gap > 59.5 THEN 1 END) AS n_gaps FROM g GROUP BY ALL), y AS (SELECT task_id, page_num, max(n) AS most FROM (SELECT task_id, page_num, y0, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY ALL),
e AS (SELECT task_id, page_num, bool_or(y0 < 84.2) AS has_header, bool_or(y0 > 757.8) AS has_footer, count(*) AS n_blocks FROM blocks GROUP BY ALL)
SELECT task_id, page_num, has_header, has_footer, cast(least(coalesce(n_gaps, 0) + 1, 3) AS INTEGER) AS n_columns, CASE WHEN n_blocks > 3 AND most >= 3 THEN 1 ELSE 0 END AS n_tables, n_blocks FROM e JOIN y USING (task_id, page_num) LEFT JOIN gs USING (task_id, page_num)""")
def _(spark, d):
    return B.page_layout(W.blocks(spark, d), 595.0, 842.0)


@_query("flt09_block_filters", f"{_LEVELS} SELECT task_id, page_num, block_num FROM lev WHERE hierarchy_level = 2 AND code IS NOT NULL AND font_size BETWEEN 9 AND 11")
def _(spark, d):
    return B.filtered(B.with_levels(_blocks(spark, d)), level=2, has_code=True, sizes=(9, 11)).select("task_id", "page_num", "block_num")


_P = f"WITH {W.PAIR_SQL}"


@_query("jn02_code_then_name", f"""{_P} SELECT r.code, r.name, CASE WHEN c.code IS NOT NULL THEN 'code' WHEN n.name IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by, CASE WHEN c.code IS NOT NULL THEN c.name WHEN n.name IS NOT NULL THEN r.name END AS found_name
FROM rules r LEFT JOIN found c ON r.code = c.code LEFT JOIN (SELECT DISTINCT name FROM found) n ON r.name = n.name""")
def _(spark, d):
    return R.matched(*W.rule_and_pdf(spark, d))


@_query("jn03_full_outer", f"{_P} SELECT coalesce(r.code, f.code) AS code, coalesce(r.name, '') AS rule_name, coalesce(f.name, '') AS pdf_name FROM rules r FULL JOIN found f ON r.code = f.code")
def _(spark, d):
    return R.fused(*W.rule_and_pdf(spark, d))


@_query("ag25_reconciliation_stats", f"{_P} SELECT CASE WHEN f.code IS NULL THEN 'rule_only' WHEN r.code IS NULL THEN 'pdf_only' WHEN r.name = f.name THEN 'same' ELSE 'name_diff' END AS kind, count(*) AS n FROM rules r FULL JOIN found f ON r.code = f.code GROUP BY 1")
def _(spark, d):
    return R.kind(R.fused(*W.rule_and_pdf(spark, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("fn26_confidence", "SELECT p_partkey, cast(round(1000 * CASE WHEN r > 0 AND p > 0 THEN 0.8 * (r + p) / 2 WHEN r > 0 THEN 0.8 * r WHEN p > 0 THEN 0.64 * p ELSE 0.8 END) AS BIGINT) AS confidence FROM (SELECT p_partkey, (p_partkey % 5) * 0.25 AS r, (p_partkey % 3) * 0.5 AS p FROM part)")
def _(spark, d):
    rows = W.table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 5) * 0.25).alias("r"), ((F.col("p_partkey") % 3) * 0.5).alias("p"))
    return rows.select("p_partkey", F.round(1000 * R.confidence(F.col("r"), F.col("p"))).cast("long").alias("confidence"))


_L = f"WITH {W.LOG_SQL}"


@_query("ag16_17_stage_metrics", f"{_L} SELECT stage, count(*) AS n, min(duration) AS min_duration, max(duration) AS max_duration, cast(sum(duration) AS BIGINT) AS sum_duration, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_errors FROM log GROUP BY stage")
def _(spark, d):
    return M.stage_metrics(W.log(spark, d))


@_query("wn10_sliding_100", f"{_L} SELECT seq, count(*) OVER w AS n_last, cast(sum(duration) OVER w AS BIGINT) AS sum_last, cast(sum(ok::INT) OVER w AS BIGINT) AS ok_last FROM log WINDOW w AS (PARTITION BY stage ORDER BY seq ROWS 99 PRECEDING)")
def _(spark, d):
    return M.sliding(W.log(spark, d)).select("seq", "n_last", "sum_last", "ok_last")


@_query("wn11_concurrency_step", "SELECT p_partkey, CASE WHEN s >= 95 AND t < 3 THEN least(c + 1, 10) WHEN 100 - s >= 20 OR t > 8 THEN greatest(c - 1, 1) ELSE c END AS next FROM (SELECT p_partkey, p_size % 11 AS c, p_partkey % 101 AS s, p_partkey % 12 AS t FROM part)")
def _(spark, d):
    k = F.col("p_partkey")
    return W.table(spark, d, "part").select(k, M.next_concurrency(F.col("p_size") % 11, (k % 101) / 100, (100 - k % 101) / 100, k % 12).alias("next"))


@_query("ag21_hourly", f"{_L} SELECT date_trunc('hour', ts) AS period, count(*) AS n, cast(sum(duration) AS BIGINT) AS sum_duration FROM log GROUP BY 1")
def _(spark, d):
    return M.periods(W.log(spark, d)).select("period", "n", "sum_duration")


@_query("wn12_recent_100", f"{_L} SELECT seq, stage FROM log ORDER BY seq DESC LIMIT 100")
def _(spark, d):
    return M.recent(W.log(spark, d)).select("seq", "stage")


@_query("sm01_fixed_windows", f"{_L} SELECT stage, cast(epoch(ts) AS BIGINT) // 3600 * 3600 AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS n_over FROM (SELECT stage, date_trunc('second', ts) AS ts FROM log) GROUP BY 1, 2")
def _(spark, d):
    return M.fixed_windows(W.log(spark, d), 3600, 2)


@_query("sm07_backoff", "SELECT p_partkey, least((p_partkey % 9) * (p_partkey % 9), 30) AS seconds FROM part")
def _(spark, d):
    return W.table(spark, d, "part").select("p_partkey", text.backoff_seconds(F.col("p_partkey") % 9).alias("seconds"))


@_query("sm09_failure_threshold", f"{_L} SELECT stage, count(*) AS n, count(CASE WHEN NOT ok THEN 1 END) AS n_errors, count(CASE WHEN NOT ok THEN 1 END) > count(*) // 2 AS failed FROM log GROUP BY stage")
def _(spark, d):
    return M.failed_too_often(W.log(spark, d))


_K = f"WITH {W.TASKS_SQL}"


@_query("tk09_priority_order", f"{_K} SELECT task_id, queue, priority, cast(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created, task_id) AS k FROM tasks) WHERE k <= 5")
def _(spark, d):
    return M.popped(W.tasks(spark, d), 5).select("task_id", "queue", "priority", "k")


@_query("tk10_best_head", f"{_K} SELECT task_id, queue, priority FROM tasks ORDER BY priority DESC, created, task_id LIMIT 1")
def _(spark, d):
    return M.best_head(W.tasks(spark, d)).select("task_id", "queue", "priority")


@_query("wn13_batches", f"{_K} SELECT queue, (k - 1) // 10 AS batch, count(*) AS n FROM (SELECT queue, row_number() OVER (PARTITION BY queue ORDER BY task_id) AS k FROM tasks) GROUP BY ALL")
def _(spark, d):
    return M.batches(W.tasks(spark, d), "queue", "task_id", 10).groupBy("queue", "batch").agg(F.count(F.lit(1)).alias("n"))


@_query("flt14_routing", f"{_K} SELECT task_id FROM tasks WHERE size >= 200 AND priority IN ('urgent', 'high') AND queue = 'user' AND size < 900 AND task_id > 2000 AND created <= 500000")
def _(spark, d):
    return M.routed(W.tasks(spark, d), [("size", "gte", 200), ("priority", "in", ["urgent", "high"]), ("queue", "eq", "user"), ("size", "lt", 900), ("task_id", "gt", 2000), ("created", "lte", 500000)]).select("task_id")


@_query("sm03_peak_overlap", f"""{_K}, m AS (SELECT queue AS kind, task_id AS moment, 1 AS d FROM tasks UNION ALL SELECT queue, task_id + size, -1 FROM tasks), s AS (SELECT kind, moment, sum(d) AS d FROM m GROUP BY ALL)
SELECT kind, cast(max(o) AS BIGINT) AS peak FROM (SELECT kind, sum(d) OVER (PARTITION BY kind ORDER BY moment) AS o FROM s) GROUP BY kind""")
def _(spark, d):
    return M.peak_overlap(W.tasks(spark, d).select(F.col("queue").alias("kind"), F.col("task_id").alias("begin"), (F.col("task_id") + F.col("size")).alias("end")))


@_query("sm04_latest_state", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def _(spark, d):
    return M.latest_state(W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


@_query("fn36_queue_names", f"{_K} SELECT task_id, CASE queue WHEN 'user' THEN 'queue:rule' WHEN 'assistant' THEN 'queue:pdf' ELSE 'queue:default' END AS name FROM tasks")
def _(spark, d):
    return W.tasks(spark, d).select("task_id", text.queue_name(F.replace(F.replace("queue", F.lit("user"), F.lit("rule")), F.lit("assistant"), F.lit("pdf"))).alias("name"))


@_query("fn21_json_part", f"{_L} SELECT seq, CASE WHEN seq % 2 = 0 THEN '[' || props || ']' ELSE props END AS found, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM log")
def _(spark, d):
    rows = W.log(spark, d).select("seq", F.concat(F.lit("```json\nhere: "), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")), F.lit(" end```")).alias("answer"))
    part = text.json_part(text.unfenced(F.col("answer")))
    return rows.select("seq", part.alias("found"), F.coalesce(F.get_json_object(part, "$[0].k"), F.get_json_object(part, "$.k")).cast("long").alias("k"))


@_query("ag22_group_by_prefix", f"{_TAX}, p AS (SELECT *, array_to_string(string_split(code, '-')[1:2], '-') AS prefix FROM tax), k AS (SELECT *, (row_number() OVER (PARTITION BY prefix ORDER BY code) - 1) // 1000 AS part FROM p) SELECT prefix, part, count(*) AS n, string_agg(code || ' ' || name, ',' ORDER BY code) AS items FROM k GROUP BY 1, 2")
def _(spark, d):
    items = F.array_join(F.transform("items", lambda x: F.concat(x["code"], F.lit(" "), x["name"])), ",")
    return H.in_prefixes(W.tax(spark, d)).select("prefix", "part", F.size("items").cast("long").alias("n"), items.alias("items"))


@_query("st06_except", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return W.table(spark, d, "customer").select("c_custkey").exceptAll(W.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@_query("fn32_md5", "SELECT doc_id, md5(text) AS hash FROM documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", text.md5_hex(F.col("text")).alias("hash"))


@_query("flt16_rate_limited", f"{_L} SELECT seq, seq % 3 = 0 OR seq % 5 = 0 AS limited FROM log")
def _(spark, d):
    k = F.col("seq")
    return W.log(spark, d).select("seq", text.is_rate_limited(F.when(k % 3 == 0, "429").otherwise("500"), F.when(k % 5 == 0, "Rate Limit hit").otherwise("failed")).alias("limited"))

"""Inputs of the operators' shapes, derived from the driver's tables; and the same in SQL, as CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import codes, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tax(spark: SparkSession, d: str, orphans: bool = False) -> DataFrame:
    """seq, code, name: regions, nations, customers and orders as four levels; with orphans some nations are missing."""
    region = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("string").alias("c1"), "r_regionkey", "r_name")
    nation = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("-", "c1", F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("c2"), "n_nationkey", "n_name")
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("-", "c2", F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("c3"), "c_custkey", "c_name")
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat_ws("-", "c3", F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("c4"), "o_orderkey", "o_orderpriority")
    shown = nation.filter(F.col("n_nationkey") % 7 != 0) if orphans else nation
    level = lambda df, k, key, code, name: df.select((F.lit(k * 10**10) + F.col(key)).alias("seq"), F.col(code).alias("code"), F.col(name).alias("name"))
    out = level(region, 0, "r_regionkey", "c1", "r_name").unionByName(level(shown, 1, "n_nationkey", "c2", "n_name"))
    return out.unionByName(level(customer, 2, "c_custkey", "c3", "c_name")).unionByName(level(orders, 3, "o_orderkey", "c4", "o_orderpriority"))


def tax_sql(orphans: bool = False) -> str:
    skip = "WHERE n_nationkey % 7 <> 0" if orphans else ""
    return f"""r AS (SELECT cast(r_regionkey + 1 AS VARCHAR) AS c1, r_regionkey, r_name FROM region),
n AS (SELECT c1 || '-' || lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS c2, n_nationkey, n_name FROM nation JOIN r ON n_regionkey = r_regionkey),
c AS (SELECT c2 || '-' || lpad(cast(c_custkey AS VARCHAR), 6, '0') AS c3, c_custkey, c_name FROM customer JOIN n ON c_nationkey = n_nationkey),
o AS (SELECT c3 || '-' || lpad(cast(o_orderkey AS VARCHAR), 8, '0') AS c4, o_orderkey, o_orderpriority FROM orders JOIN c ON o_custkey = c_custkey),
tax0 AS (SELECT r_regionkey AS seq, c1 AS code, r_name AS name FROM r UNION ALL SELECT 10000000000 + n_nationkey, c2, n_name FROM n {skip}
  UNION ALL SELECT 20000000000 + c_custkey, c3, c_name FROM c UNION ALL SELECT 30000000000 + o_orderkey, c4, o_orderpriority FROM o),
tax AS (SELECT *, CASE WHEN contains(code, '-') THEN regexp_replace(code, '-[^-]*$', '') ELSE '' END AS parent, len(string_split(code, '-')) AS parts FROM tax0)"""


#: Names of levels by number of parts, in SQL.
LEVEL_SQL = "CASE parts WHEN 1 THEN '大类' WHEN 2 THEN '中类' WHEN 3 THEN '小类' WHEN 4 THEN '细类' ELSE '未知级别' END"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """row_idx, cells: a ragged row for each customer, of skeleton text, codes and names by lines, and some junk."""
    orders = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("1-01-"), F.lpad((F.col("o_custkey") % 90).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("code"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit(" Job "), F.col("o_orderkey").cast("string"))).alias("name"), "o_orderkey")
    lists = orders.groupBy("o_custkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "code"))), lambda x: x["code"]), "\n").alias("e"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("o_orderkey", "name")))), lambda x: x["name"]), "\n").alias("f"),
    )
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_idx"), "c_nationkey").join(lists, F.col("row_idx") == F.col("o_custkey"), "left")
    k = F.col("row_idx")
    a = F.when(k % 13 == 0, "大类").when(k % 17 == 0, "续 表").otherwise(F.concat(F.lit("Part "), (k % 8 + 1).cast("string"), F.lit(" (GBM "), (k * 10).cast("string"), F.lit(") tail 2")))
    b = F.concat((k % 8 + 1).cast("string"), F.lit("-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("  name"))
    full = F.array(a, b, F.lit(""), F.lit(""), F.coalesce("e", F.lit("")), F.coalesce("f", F.lit("")))
    return rows.select("row_idx", F.when(k % 19 == 0, F.slice(full, 1, 3)).otherwise(full).alias("cells"))


CELLS_SQL = r"""raw AS (SELECT o_custkey, string_agg('1-01-' || lpad(cast(o_custkey % 90 AS VARCHAR), 2, '0') || '-' || lpad(cast(o_orderkey AS VARCHAR), 8, '0'), chr(10) ORDER BY o_orderkey) AS e,
  string_agg(' Job ' || o_orderkey, chr(10) ORDER BY o_orderkey) FILTER (o_orderkey % 11 <> 0) AS f FROM orders GROUP BY o_custkey),
cells AS (SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 13 = 0 THEN '大类' WHEN c_custkey % 17 = 0 THEN '续 表' ELSE 'Part ' || (c_custkey % 8 + 1) || ' (GBM ' || (c_custkey * 10) || ') tail 2' END AS a,
  (c_custkey % 8 + 1) || '-' || lpad(cast(c_custkey % 100 AS VARCHAR), 2, '0') || '  name' AS b, coalesce(e, '') AS e, coalesce(f, '') AS f, CASE WHEN c_custkey % 19 = 0 THEN 3 ELSE 6 END AS n,
  c_custkey % 13 = 0 OR c_custkey % 17 = 0 AS junk FROM customer LEFT JOIN raw ON o_custkey = c_custkey)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """A block for each non-blank line of documents: task = source, page = document."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("source").alias("task_id"), F.col("doc_id").alias("page_num"), F.posexplode(F.split("text", "\n")).alias("block_num", "line")).filter(F.regexp_replace("line", r"[ \t\n\f\r]", "") != "")
    k, n = F.col("block_num"), F.length("line")
    code = F.concat(F.lit("1-"), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit("-0"), (k % 9).cast("string"), F.lit("-01"))
    content = F.when(k % 5 == 0, F.concat(code, F.lit(" x"))).when(k % 5 == 1, F.concat(F.lit("技术员"), k.cast("string"))).otherwise(F.col("line"))
    return lines.select(
        "task_id", "page_num", "block_num", content.alias("text"), ((k * 7) % 80).cast("double").alias("x0"), (F.floor(k / 2) * 12).cast("double").alias("y0"), ((k * 7) % 80 + 100).cast("double").alias("x1"), (F.floor(k / 2) * 12 + 10).cast("double").alias("y1"),
        F.concat(F.lit("f"), (n % 3).cast("string")).alias("font"), (8 + n % 5).cast("double").alias("font_size"), (F.when(k % 4 == 0, 16).otherwise(0) + F.when(k % 6 == 1, 2).otherwise(0)).alias("flags"),
    )


BLOCKS_SQL = r"""lines AS (SELECT source AS task_id, doc_id AS page_num, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_num FROM documents),
b0 AS (SELECT *, length(line) AS n, block_num AS k FROM lines WHERE regexp_replace(line, '[ \t\n\f\r]', '', 'g') <> ''),
blocks AS (SELECT task_id, page_num, block_num, CASE WHEN k % 5 = 0 THEN '1-' || (n % 90 + 10) || '-0' || (k % 9) || '-01 x' WHEN k % 5 = 1 THEN '技术员' || k ELSE line END AS text,
  (k * 7) % 80 AS x0, (k // 2) * 12 AS y0, (k // 2) * 12 + 5 AS yc, 'f' || (n % 3) AS font, 8 + n % 5 AS font_size, k % 4 = 0 AS is_bold, k % 6 = 1 AS is_italic, CASE WHEN k % 5 = 0 THEN '1-' || (n % 90 + 10) || '-0' || (k % 9) || '-01' END AS code FROM b0)"""


def rule_and_pdf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as rules, and a thinned and partly renamed copy with codes of its own as what was found."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"))
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code"))
    found = rows.filter(k % 3 != 0).select(k.alias("seq"), code.alias("code"), F.when(k % 5 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name")).alias("name"))
    return rows.select("code", "name"), found


PAIR_SQL = """rules AS (SELECT 'C' || c_custkey AS code, c_name AS name FROM customer),
found AS (SELECT c_custkey AS seq, 'C' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END AS code, c_name || CASE WHEN c_custkey % 5 = 0 THEN '*' ELSE '' END AS name FROM customer WHERE c_custkey % 3 <> 0)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as categories: a task for 50 customers' keys, a batch a year; the newest year is current."""
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("task_id"), F.concat(F.lit("1-"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("code"), F.col("o_orderpriority").alias("name"),
        F.year("o_orderdate").alias("batch_id"), F.year("o_orderdate").alias("batch_ts"), F.col("o_orderstatus").alias("status"),
    )
    last = rows.groupBy("task_id").agg(F.max("batch_id").alias("_last"))
    return rows.join(last, "task_id").withColumn("is_current", F.col("batch_id") == F.col("_last")).drop("_last").withColumn("parent_code", codes.parent_code(F.col("code")))


VERSIONS_SQL = """v0 AS (SELECT o_custkey % 50 AS task_id, '1-' || lpad(cast(o_orderkey % 97 AS VARCHAR), 2, '0') || '-' || o_orderkey AS code, o_orderpriority AS name, cast(year(o_orderdate) AS INTEGER) AS batch_id, o_orderstatus AS status,
  '1-' || lpad(cast(o_orderkey % 97 AS VARCHAR), 2, '0') AS parent_code FROM orders),
v AS (SELECT *, batch_id = max(batch_id) OVER (PARTITION BY task_id) AS is_current FROM v0)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("duration"), (F.col("event_id") % 10 != 9).alias("ok"), "props")


LOG_SQL = "log AS (SELECT event_id AS seq, ts, event_type AS stage, cast(round(value * 100) AS BIGINT) AS duration, event_id % 10 <> 9 AS ok, props FROM events)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    names = F.array(*map(F.lit, ("urgent", "normal", "low", "high")))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.col("role").alias("queue"), F.get(names, (F.col("turn") % 4).cast("int")).alias("priority"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created"), F.length("text").alias("size"))


TASKS_SQL = "tasks AS (SELECT conv_id * 1000 + turn AS task_id, role AS queue, ['urgent', 'normal', 'low', 'high'][turn % 4 + 1] AS priority, conv_id * 1000 + turn AS created, length(text) AS size FROM conversations)"


def messy(spark: SparkSession, d: str) -> DataFrame:
    """key, raw: nation names with odd white space and CJK words."""
    space = F.get(F.array(*[F.lit(c) for c in text.SPACES[:3] + "\t\n"]), (F.col("n_nationkey") % 5).cast("int"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("　 "), F.col("n_name"), space, F.lit("技 术"), space, F.lit("员 x "), F.col("n_name"), F.lit("\r\n")).alias("raw"))


MESSY_SQL = "messy AS (SELECT n_nationkey AS key, n_name FROM nation)"

"""Queries for answers, validation, graphs, pages of results, sets and control, and what DuckDB should give for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import registry
from lattica.functions import codes, text
from lattica.operators import answers as A
from lattica.operators import blocks as B
from lattica.operators import graphs as G
from lattica.operators import hierarchy as H
from lattica.operators import metrics as M
from lattica.operators import pages as P
from lattica.operators import reconcile as R
from lattica.operators import tasks as K
from lattica.operators import validation as D
from lattica.operators import versions as V
from lattica.plans import views as W
from lattica.plans.queries import _BAD, _DASHES, _DEPTH, _bad, _query, _tree
from lattica.sources import folders, objects, sinks
from lattica.streaming import tasks as S

_T, _B, _V, _L, _TAX, _P = f"WITH {W.TASKS_SQL}", f"WITH {W.BLOCKS_SQL}", f"WITH {W.VERSIONS_SQL}", f"WITH {W.LOG_SQL}", f"WITH {W.tax_sql()}", f"WITH {W.PAIR_SQL}"
_N = lambda name="n": F.count(F.lit(1)).alias(name)


def _blocks(spark, d):
    return B.derived(W.blocks(spark, d))


# Answers of a model, for each part: a wrapper, a fenced array, a cut one, none.
def _answers(spark, d):
    k = F.col("p_partkey")
    item = lambda n: F.to_json(F.struct(F.concat(k.cast("string"), F.lit(f"-{n}")).alias("code"), F.col("p_name").alias("name")))
    both = F.concat(item(1), F.lit(","), item(2))
    broken = F.concat(F.lit("[\n"), item(1), F.lit(",\n"), item(2), F.lit(',\n{"code": "cut'))
    form = F.when(k % 4 == 0, F.concat(F.lit('Here: {"items": ['), both, F.lit("]}"))).when(k % 4 == 1, F.concat(F.lit("```json\n["), both, F.lit("]\n```"))).when(k % 4 == 2, broken).otherwise("nothing")
    return W.table(spark, d, "part").select("p_partkey", "p_name", form.alias("answer"))


@_query("fn22_23_parse_answers", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS n_items, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_partkey || '-1,' || p_partkey || '-2' END AS codes, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS first_name FROM part")
def _(spark, d):
    rows = _answers(spark, d).select("p_partkey", A.items(F.col("answer")).alias("items"))
    return rows.select("p_partkey", F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda x: x["code"]), ",").alias("codes"), F.get("items", F.lit(0))["name"].alias("first_name"))


@_query("fn24_first_500", "SELECT c_nationkey, least(n, 500) AS n_kept, n AS n_all FROM (SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _(spark, d):
    item = F.create_map(F.lit("code"), F.col("o_orderkey").cast("string"), F.lit("name"), F.col("o_orderpriority"))
    rows = W.table(spark, d, "orders").join(W.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", item.alias("item"))
    kept = A.first_items(rows, "c_nationkey", ["o_orderkey"], "item").select("c_nationkey", F.size(A.core_fields(A.valid_items(F.col("items")))).cast("long").alias("n_kept"))
    return kept.join(rows.groupBy("c_nationkey").agg(_N("n_all")), "c_nationkey")


@_query("flt13_fn24_core_fields", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END AS n_core FROM part")
def _(spark, d):
    return _answers(spark, d).select("p_partkey", F.size(A.core_fields(A.valid_items(A.items(F.col("answer"))), 1)).alias("n_core"))


@_query("fn25_truncated", "WITH x AS (SELECT o_custkey, sum(11 + length(cast(o_orderkey AS VARCHAR))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bytes FROM orders) SELECT o_custkey, count(CASE WHEN bytes <= 60 THEN 1 END) AS n_kept, count(*) AS n_all FROM x GROUP BY 1")
def _(spark, d):
    rows = W.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("code")))).alias("items"))
    return rows.select("o_custkey", F.size(A.truncated(F.transform("items", lambda x: F.struct(x["code"].cast("string").alias("code"))), 60)).cast("long").alias("n_kept"), F.size("items").cast("long").alias("n_all"))


@_query("fn27_28_defaults", f"{_P} SELECT r.code, r.name AS name, 0.5::DOUBLE AS confidence, f.name AS alternative, CASE WHEN len(r.code) % 2 = 0 THEN f.name ELSE r.name END AS other FROM rules r LEFT JOIN found f USING (code)")
def _(spark, d):
    rules, found = W.rule_and_pdf(spark, d)
    rows = rules.join(found.select("code", F.col("name").alias("found")), "code", "left")
    made = A.default_result(F.col("name"), F.col("found"))
    return rows.select("code", made["name"].alias("name"), made["confidence"].alias("confidence"), made["alternative"].alias("alternative"), A.alternative(F.when(F.length("code") % 2 == 0, "rule").otherwise("pdf"), F.col("name"), F.col("found")).alias("other"))


@_query("fn34_prompt_kinds", "SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS keys, 4 AS n_kinds FROM nation GROUP BY 1")
def _(spark, d):
    made = None
    for kind, template in A.PROMPTS.items():
        own = A.prompts(W.table(spark, d, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey"], template).select("n_regionkey", F.lit(kind).alias("kind"), "prompt")
        made = own if made is None else made.unionByName(own)
    keys = F.array_join(F.transform(F.from_json(text.json_part(F.regexp_replace("prompt", r"^[^:]*\{\"items\": \[...\]\}", "")), "array<struct<n_nationkey:int>>"), lambda x: x["n_nationkey"].cast("string")), ",")
    return made.select("n_regionkey", keys.alias("keys"), "kind").groupBy("n_regionkey", "keys").agg(F.count_distinct("kind").cast("int").alias("n_kinds"))


@_query("fn34_prompts", """SELECT n_regionkey, 'Region ' || n_regionkey || ': [' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS prompt FROM nation GROUP BY n_regionkey""")
def _(spark, d):
    return A.prompts(W.table(spark, d, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"], "Region %s: %s")


@_query("ux01_model_call", "SELECT n_nationkey, upper(n_name) AS answer FROM nation")
def _(spark, d):
    return A.answered(W.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("prompt")), str.upper).select("n_nationkey", "answer")


@_query("fn31_previews", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview FROM documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@_query("fn33_flt12_has_values", "SELECT doc_id, coalesce(text, '') <> '' AS has_text FROM documents")
def _(spark, d):
    return W.table(spark, d, "documents").select("doc_id", text.has_value(F.col("text")).alias("has_text"))


@_query("fn35_unfenced", "SELECT p_partkey, '{\"n\":' || p_partkey || '}' AS body FROM part")
def _(spark, d):
    return W.table(spark, d, "part").select("p_partkey", text.unfenced(F.concat(F.lit('```json\n{"n":'), F.col("p_partkey").cast("string"), F.lit("}\n```"))).alias("body"))


@_query("fn37_durations", "SELECT o_orderkey, cast(CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 7) * 86400 ELSE epoch(TIMESTAMP '2000-01-01') - epoch(o_orderdate::TIMESTAMP) END AS BIGINT) AS seconds FROM orders")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    ended = F.when(F.col("o_orderstatus") == "F", F.date_add(day, (F.col("o_orderkey") % 7).cast("int")))
    return W.table(spark, d, "orders").select("o_orderkey", K.duration(day, ended, F.lit("2000-01-01").cast("date")).alias("seconds"))


@_query("fn38_units", "SELECT doc_id, round_even(n_chars * 1000 / 1024 / 1024, 2) AS mb, round_even(n_chars / 1024, 2) AS kb, coalesce(round_even(n_chars / nullif(doc_id % 4, 0), 1), 0.0) AS mean FROM documents")
def _(spark, d):
    n = F.col("n_chars")
    return W.table(spark, d, "documents").select("doc_id", text.megabytes(n * 1000).alias("mb"), text.kilobytes(n).alias("kb"), text.mean_of(n, F.col("doc_id") % 4).alias("mean"))


@_query("flt18_src11_paths", "SELECT p_partkey, p_partkey % 3 <> 0 AS is_local, p_partkey % 2 = 0 AS is_sheet FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 3 == 1, "/data/").when(k % 3 == 2, "C:\\data\\").otherwise("bucket/"), k.cast("string"), F.when(k % 2 == 0, ".XLSX").otherwise(".pdf"))
    return W.table(spark, d, "part").select("p_partkey", objects.is_local(path).alias("is_local"), objects.fits_type(path).alias("is_sheet"))


@_query("src07_08_objects", "SELECT * FROM (VALUES ('region.parquet', 'parquet'), ('nation.parquet', 'parquet'), ('part.parquet', 'parquet')) t(name, type)")
def _(spark, d):
    return objects.stat(spark, d, "{region,nation,part}.parquet").filter("length > 0 and etag <> '' and modified is not null").select("name", "type")


@_query("src06_object_content", "SELECT 'region.parquet' AS name, true AS is_whole, 'PAR1' AS head")
def _(spark, d):
    name = F.element_at(F.split("path", "/"), -1)
    return objects.content(spark, f"{d}/region.parquet").select(name.alias("name"), ((F.octet_length("content") == F.col("length")) & (F.md5("content") == F.col("md5"))).alias("is_whole"), F.substring("content", 1, 4).cast("string").alias("head"))


@_query("src10_confidence", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence FROM part")
def _(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") % 3 != 0, 0.25).alias("confidence"))).alias("codes")))
    rows = W.table(spark, d, "part").select(F.explode(A.occupation_codes(body)).alias("c"))
    return rows.select(F.col("c.code").cast("long").alias("p_partkey"), "c.confidence")


@_query("src04_spans", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id AS page_num, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS block_num, md5(line) AS hash FROM s WHERE regexp_replace(line, '[ \t\n\f\r]', '', 'g') <> ''""")
def _(spark, d):
    span = lambda x: F.struct(x.alias("text"), F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))).alias("bbox"), F.lit("f").alias("font"), F.lit(9.0).alias("size"), F.lit(0).alias("flags"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.array(span(x)).alias("spans")))
    pages = W.table(spark, d, "documents").select("source", F.col("doc_id").alias("page_num"), F.array(F.struct(lines.alias("lines"))).alias("blocks")).withColumnRenamed("source", "task_id")
    return B.from_pages(pages).select("page_num", "block_num", F.md5("text").alias("hash"))


@_query("snk07_without_task", f"{_V} SELECT task_id, count(*) AS n FROM v WHERE task_id NOT IN (1, 2) GROUP BY 1")
def _(spark, d):
    gone = spark.range(1, 3).select(F.col("id").alias("task_id"))
    return sinks.without_task(W.versions(spark, d), gone).groupBy("task_id").agg(_N())


@_query("snk08_json_export", f"""{_V} SELECT '{{"code":"' || code || '","name":"' || name || '"}}' AS value FROM v WHERE is_current""")
def _(spark, d):
    return sinks.json_lines(W.versions(spark, d).filter("is_current"), ["code", "name"])


@_query("jn09_unfilled", f"{_P} SELECT r.code, CASE WHEN len(r.code) % 2 = 0 THEN r.name ELSE coalesce(f.name, '') END AS name FROM rules r LEFT JOIN found f USING (code)")
def _(spark, d):
    rules, found = W.rule_and_pdf(spark, d)
    rows = rules.withColumn("name", F.when(F.length("code") % 2 == 0, F.col("name")).otherwise(""))
    return V.filled(rows, found, "name")


@_query("flt12_unfilled", f"{_P} SELECT code FROM rules WHERE len(code) % 2 = 1")
def _(spark, d):
    rules, _ = W.rule_and_pdf(spark, d)
    return V.unfilled(rules.withColumn("name", F.when(F.length("code") % 2 == 0, F.col("name")).otherwise("")), "name").select("code")


@_query("jn07_small_of_detail", f"{_TAX} SELECT d.code, s.code AS small, s.name AS small_name FROM tax d JOIN tax s ON d.parent = s.code WHERE d.parts = 4")
def _(spark, d):
    return H.small_of_details(W.tax(spark, d)).select("code", "small", "small_name")


@_query("vd02_standard", "SELECT source AS doc, count(*) AS n_pages, cast(sum(length(coalesce(text, ''))) + count(*) - 1 AS BIGINT) AS text_length, true AS is_valid FROM documents GROUP BY 1")
def _(spark, d):
    return D.verdict(D.page_facts(_pages(spark, d))).select("doc", "n_pages", "text_length", "is_valid")


def _pages(spark, d):
    return W.table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page_num"), (F.col("doc_id") % 2 + 100).alias("width"), F.lit(200).alias("height"), "text")


@_query("vd03_ag14_quality", "SELECT source AS doc, count(DISTINCT doc_id % 2) <= 2 AS consistent_page_sizes, cast(floor(sum((doc_id % 2 + 100) * 200) / count(*)) AS BIGINT) AS area, count(CASE WHEN length(text) > 0 THEN 1 END) = count(*) AS all_read FROM documents GROUP BY 1")
def _(spark, d):
    return D.quality(D.page_facts(_pages(spark, d))).select("doc", "consistent_page_sizes", F.floor("average_page_size").alias("area"), (F.col("text_success_rate") == 1).alias("all_read"))


@_query("vd04_gn06_strict", "SELECT conv_id, unnest(list_filter([CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 0 THEN 'no Title' END, 'no Author'], lambda x: x IS NOT NULL)) AS warning FROM conversations GROUP BY conv_id")
def _(spark, d):
    turns = W.table(spark, d, "conversations")
    facts = D.page_facts(turns.select(F.col("conv_id").alias("doc"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("text")))
    titles = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.max(F.when(F.col("role") == "system", "t")).alias("Title"))
    return D.verdict(facts.join(titles, "doc").withColumn("Author", F.lit("")), ["Title", "Author"], strict=True).select(F.col("doc").alias("conv_id"), F.explode("warnings").alias("warning"))


@_query("ag15_structure", "SELECT o_custkey IS NOT NULL AS has_toc, c_custkey AS doc, coalesce(n, 0) AS toc_entries FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, d):
    entries = W.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("level"))
    return D.structure(W.table(spark, d, "customer").select(F.col("c_custkey").alias("doc")), entries).select("doc", "has_toc", "toc_entries")


@_query("vd05_fonts", f"{_B} SELECT task_id AS doc, bool_and(font <> 'f1') AS fonts_embedded FROM blocks WHERE page_num < 5 GROUP BY 1")
def _(spark, d):
    return D.fonts_embedded(W.blocks(spark, d).select(F.col("task_id").alias("doc"), "page_num", (F.col("font") != "f1").alias("embedded"))).select("doc", "fonts_embedded")


@_query("vd01_file_errors", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'too large' WHEN n_chars = 0 THEN 'empty' ELSE '' END AS error FROM documents")
def _(spark, d):
    return D.file_errors(W.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length")), 5000).select("doc_id", F.array_join("errors", ",").alias("error"))


@_query("vd01_missing_files", "SELECT p_partkey AS name, CASE WHEN doc_id IS NULL THEN 'missing' WHEN n_chars > 5000 THEN 'too large' WHEN n_chars = 0 THEN 'empty' ELSE '' END AS error FROM part LEFT JOIN documents ON doc_id = p_partkey")
def _(spark, d):
    names = W.table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    files = W.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("length"))
    return D.file_errors(D.expected(names, files), 5000).select("name", F.array_join("errors", ",").alias("error"))


@_query("vd06_images", "SELECT page_id AS doc, cast(k AS INTEGER) AS image_index, cast(k AS INTEGER) * 10 AS width FROM pages, range(2) r(k)")
def _(spark, d):
    image = lambda k: F.struct(F.lit(10 * k).alias("width"))
    return D.images(W.table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.lit(0).alias("page_num"), F.array(image(0), image(1)).alias("images"))).select("doc", "image_index", "width")


_PAGES = f"""{_B}, g AS (SELECT task_id, page_num, x0 - lag(x0) OVER (PARTITION BY task_id, page_num ORDER BY x0, block_num) AS gap FROM blocks WHERE y0 > 84.2 AND y0 < 757.8), gs AS (SELECT task_id, page_num, count(CASE WHEN gap > 59.5 THEN 1 END) AS n_gaps FROM g GROUP BY ALL),
y AS (SELECT task_id, page_num, max(n) AS most FROM (SELECT task_id, page_num, y0, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY ALL), e AS (SELECT task_id, page_num, bool_or(y0 < 84.2) AS has_header, bool_or(y0 > 757.8) AS has_footer, count(*) AS n_blocks FROM blocks GROUP BY ALL),
fo AS (SELECT task_id, page_num, font FROM (SELECT task_id, page_num, font, count(*) AS n FROM blocks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id, page_num ORDER BY n DESC, font) = 1),
z AS (SELECT task_id, page_num, string_agg(font_size || ':' || n, ',' ORDER BY font_size) AS font_sizes FROM (SELECT task_id, page_num, font_size, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY ALL),
p AS (SELECT source AS task_id, doc_id AS page_num, n_chars * 100 AS image_size, doc_id % 3 AS n_images FROM documents),
snaps AS (SELECT p.task_id, p.page_num + 1 AS page_num, image_size, coalesce(n_blocks, 0) AS text_blocks_count, n_images, CASE WHEN n_blocks > 3 AND most >= 3 THEN 1 ELSE 0 END AS tables_count, fo.font AS primary_font, font_sizes,
  coalesce(has_header, false) AS has_header, coalesce(has_footer, false) AS has_footer, cast(CASE WHEN n_blocks IS NULL THEN 1 ELSE least(coalesce(n_gaps, 0) + 1, 3) END AS INTEGER) AS columns_count
  FROM p LEFT JOIN e USING (task_id, page_num) LEFT JOIN y USING (task_id, page_num) LEFT JOIN gs USING (task_id, page_num) LEFT JOIN fo USING (task_id, page_num) LEFT JOIN z USING (task_id, page_num))"""


def _snapshots(spark, d):
    pages = W.table(spark, d, "documents").select(F.col("source").alias("task_id"), F.col("doc_id").alias("page_num"), (F.col("n_chars") * 100).alias("image_size"), (F.col("doc_id") % 3).alias("n_images"))
    return P.snapshots(W.blocks(spark, d), pages)


def _pairs(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",")


@_query("snk06_ag11_12_page_snapshots", f"{_PAGES} SELECT * FROM snaps")
def _(spark, d):
    return _snapshots(spark, d).withColumn("font_sizes", _pairs("font_sizes"))


@_query("ag10_snapshot_statistics", f"""{_PAGES}, u AS (SELECT task_id, string_agg(primary_font || ':' || n, ',' ORDER BY primary_font) AS font_usage FROM (SELECT task_id, primary_font, count(*) AS n FROM snaps WHERE primary_font IS NOT NULL GROUP BY ALL) GROUP BY 1),
c AS (SELECT task_id, string_agg(columns_count || ':' || n, ',' ORDER BY columns_count) AS column_distribution FROM (SELECT task_id, columns_count, count(*) AS n FROM snaps GROUP BY ALL) GROUP BY 1)
SELECT task_id, count(*) AS total_pages, cast(sum(image_size) AS BIGINT) AS total_size, round_even(sum(image_size)::DOUBLE / 1024 / 1024, 2) AS total_size_mb, round_even(sum(image_size)::DOUBLE / count(*) / 1024, 2) AS average_size_kb, cast(sum(text_blocks_count) AS BIGINT) AS total_text_blocks,
  cast(sum(n_images) AS BIGINT) AS total_images, cast(sum(tables_count) AS BIGINT) AS total_tables, round_even(sum(text_blocks_count)::DOUBLE / count(*), 1) AS avg_text_blocks_per_page, round_even(sum(n_images)::DOUBLE / count(*), 1) AS avg_images_per_page,
  count(CASE WHEN has_header THEN 1 END) AS pages_with_header, count(CASE WHEN has_footer THEN 1 END) AS pages_with_footer, any_value(font_usage) AS font_usage, any_value(column_distribution) AS column_distribution FROM snaps LEFT JOIN u USING (task_id) LEFT JOIN c USING (task_id) GROUP BY 1""")
def _(spark, d):
    return P.statistics(_snapshots(spark, d)).withColumns({c: _pairs(c) for c in ("font_usage", "column_distribution")})


@_query("ag29_batch_rollup", f"{_PAGES} SELECT task_id, count(*) AS total_pages, cast(sum(image_size) AS BIGINT) AS total_size, avg(text_blocks_count) AS avg_text_blocks FROM snaps GROUP BY 1")
def _(spark, d):
    return P.rollup(_snapshots(spark, d))


@_query("tk14_snapshots_by_page", f"{_PAGES} SELECT page_num, text_blocks_count FROM snaps WHERE task_id = 'src1'")
def _(spark, d):
    return P.by_page(_snapshots(spark, d), "src1").select("page_num", "text_blocks_count")


_Q = f"""{_T}, kt AS (SELECT *, CASE WHEN queue = 'user' THEN 'rule' WHEN queue = 'assistant' THEN 'pdf' ELSE queue END AS kind, ['pending', 'queued', 'running', 'completed', 'failed', 'cancelled'][task_id % 6 + 1] AS status, TIMESTAMP '2024-01-01' + to_seconds(task_id) AS made FROM tasks)"""


def _kinds(spark, d):
    """Tasks with a kind, a status, and a time of creation."""
    kind = F.when(F.col("queue") == "user", "rule").when(F.col("queue") == "assistant", "pdf").otherwise(F.col("queue"))
    status = F.get(F.array(*map(F.lit, K.STATES)), (F.col("task_id") % 6).cast("int"))
    return W.tasks(spark, d).withColumns({"kind": kind, "status": status}).withColumn("created", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("task_id")))


_STATES = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in K.STATES)


@_query("ag18_status_pivot", f"{_Q} SELECT kind, {_STATES}, count(*) AS total FROM kt GROUP BY kind")
def _(spark, d):
    return K.status_counts(_kinds(spark, d), "kind")


@_query("flt11_task_status", f"{_Q} SELECT task_id FROM kt WHERE status = 'failed'")
def _(spark, d):
    return K.with_status(_kinds(spark, d), "failed").select("task_id")


@_query("flt08_by_status", f"{_V} SELECT code, name FROM v WHERE task_id = 7 AND status = 'O'")
def _(spark, d):
    return V.by_status(W.versions(spark, d), 7, "O").select("code", "name")


@_query("tk04_tasks_page_total", f"{_Q} SELECT task_id, (SELECT count(*) FROM kt WHERE status = 'queued') AS total FROM kt WHERE status = 'queued' ORDER BY made DESC, task_id LIMIT 20 OFFSET 10")
def _(spark, d):
    return K.page_of(K.with_status(_kinds(spark, d), "queued"), [F.desc("created"), "task_id"], 20, 10).select("task_id", "total")


@_query("snk09_sm06_enqueued", f"{_Q} SELECT task_id, CASE kind WHEN 'rule' THEN 'queue:rule' WHEN 'pdf' THEN 'queue:pdf' ELSE 'queue:default' END AS queue, made + INTERVAL 24 HOUR AS expires FROM kt")
def _(spark, d):
    return K.enqueued(_kinds(spark, d)).select("task_id", "queue", "expires")


@_query("sm06_alive", f"{_Q} SELECT task_id FROM kt WHERE made + INTERVAL 24 HOUR > TIMESTAMP '2024-01-05'")
def _(spark, d):
    return K.alive(K.enqueued(_kinds(spark, d)), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).select("task_id")


@_query("src09_dequeued", f"{_Q} SELECT task_id, cast(k AS INTEGER) AS k FROM (SELECT task_id, row_number() OVER (PARTITION BY queue ORDER BY made, task_id) AS k FROM kt) WHERE k <= 7")
def _(spark, d):
    return K.dequeued(_kinds(spark, d), 7).select("task_id", "k")


_C = """changes AS (SELECT user_id AS task_id, event_id AS seq, ['pending', 'queued', 'running', 'completed', 'failed', 'cancelled'][event_id % 6 + 1] AS status FROM events),
walk AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY task_id ORDER BY seq), 'pending') AS was FROM changes)"""


def _changes(spark, d):
    return W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, K.STATES)), (F.col("event_id") % 6).cast("int")).alias("status"), F.lit("broken").alias("error"))


@_query("sm04_transitions", f"WITH {_C} SELECT seq, was, (was = 'pending' AND status IN ('queued', 'cancelled')) OR (was = 'queued' AND status IN ('running', 'cancelled')) OR (was = 'running' AND status IN ('completed', 'failed', 'cancelled')) AS legal FROM walk")
def _(spark, d):
    return K.walked(_changes(spark, d)).select("seq", "was", "legal")


@_query("sm10_events", f"WITH {_C} SELECT seq, CASE status WHEN 'running' THEN 'started' ELSE status END AS event, CASE status WHEN 'running' THEN 0.0 WHEN 'completed' THEN 100.0 END::DOUBLE AS progress, CASE WHEN status = 'failed' THEN 'broken' END AS message FROM changes WHERE status IN ('running', 'completed', 'failed')")
def _(spark, d):
    return K.events(_changes(spark, d)).select("seq", "event", "progress", "message")


@_query("sm01_arrival_windows", f"""WITH RECURSIVE {W.LOG_SQL}, o AS (SELECT stage AS kind, cast(floor(epoch(ts)) AS BIGINT) AS "at", row_number() OVER (PARTITION BY stage ORDER BY floor(epoch(ts))) AS r FROM log),
f AS (SELECT kind, r, "at", "at" AS ws, 1::BIGINT AS n FROM o WHERE r = 1 UNION ALL SELECT o.kind, o.r, o."at", CASE WHEN o."at" - f.ws >= 3600 THEN o."at" ELSE f.ws END, CASE WHEN o."at" - f.ws >= 3600 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.kind = f.kind AND o.r = f.r + 1)
SELECT kind, "at", ws AS window_start, n AS n_in_window FROM f""")
def _(spark, d):
    return K.arrival_windows(W.log(spark, d).select(F.col("stage").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), 3600)


_SPANS = "o AS (SELECT queue AS kind, task_id AS b, task_id + coalesce(size, 0) + 1 AS e, row_number() OVER (PARTITION BY queue ORDER BY task_id) AS r FROM tasks)"


@_query("sm03_granted", f"""WITH RECURSIVE {W.TASKS_SQL}, {_SPANS},
f AS (SELECT kind, r, b, [e] AS held, true AS granted FROM o WHERE r = 1 UNION ALL SELECT kind, r, b, CASE WHEN len(held) < CASE kind WHEN 'user' THEN 2 ELSE 1 END THEN list_append(held, e) ELSE held END, len(held) < CASE kind WHEN 'user' THEN 2 ELSE 1 END
  FROM (SELECT o.kind, o.r, o.b, o.e, list_filter(f.held, lambda x: x > o.b) AS held FROM f JOIN o ON o.kind = f.kind AND o.r = f.r + 1))
SELECT b AS task_id, granted FROM f""")
def _(spark, d):
    spans = W.tasks(spark, d).select(F.col("queue").alias("kind"), F.col("task_id").alias("begin"), (F.col("task_id") + F.coalesce("size", F.lit(0)) + 1).alias("end"))
    return K.granted(spans, {"user": 2}).select(F.col("begin").alias("task_id"), "granted")


@_query("sm11_bounded_queue", f"""WITH RECURSIVE {W.LOG_SQL}, o AS (SELECT stage AS kind, seq AS "at", seq % 23 AS took, row_number() OVER (PARTITION BY stage ORDER BY seq) AS r FROM log),
f AS (SELECT kind, r, "at", ["at" + took] AS ends, false AS dropped FROM o WHERE r = 1 UNION ALL SELECT kind, r, "at", CASE WHEN len(ends) > 2 THEN ends ELSE list_append(ends, greatest("at", coalesce(ends[-1], "at")) + took) END, len(ends) > 2
  FROM (SELECT o.kind, o.r, o."at", o.took, list_filter(f.ends, lambda x: x > o."at") AS ends FROM f JOIN o ON o.kind = f.kind AND o.r = f.r + 1))
SELECT "at", dropped FROM f""")
def _(spark, d):
    return K.bounded_queue(W.log(spark, d).select(F.col("stage").alias("kind"), F.col("seq").alias("at"), (F.col("seq") % 23).alias("took")), 2).select("at", "dropped")


@_query("sm12_run_limits", "SELECT p_partkey, CASE WHEN s >= 600 THEN 'killed' WHEN s >= 540 THEN 'warned' ELSE 'finished' END AS outcome, least(s, 600) AS given FROM (SELECT p_partkey, p_partkey % 700 AS s FROM part)")
def _(spark, d):
    return K.run_limits(W.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 700).alias("seconds"))).select("p_partkey", "outcome", "given")


@_query("sm08_ratelimit_waits", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 BETWEEN 1 AND 3 THEN p_partkey % 5 * 30 END AS wait FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    return W.table(spark, d, "part").select(k, K.wait_seconds(k % 5, k % 2 == 0).alias("wait"))


@_query("sm13_health", f"{_L} SELECT stage AS provider, cast(floor(epoch(ts)) AS BIGINT) // 30 * 30 AS poll, arg_max(ok, (ts, seq)) AS available, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_errors FROM log GROUP BY 1, 2")
def _(spark, d):
    return K.health(W.log(spark, d).withColumnRenamed("stage", "provider"))


@_query("jn10_task_children", "SELECT o.o_custkey AS parent_task_id, p.c_custkey AS child_task_id, p.c_name FROM orders o JOIN customer p ON p.c_custkey = o.o_orderkey % 1000 + 1 WHERE o.o_orderstatus = 'P' AND o.o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    own = W.table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_name")
    relations = W.table(spark, d, "orders").select(F.col("o_custkey").alias("parent_task_id"), (F.col("o_orderkey") % 1000 + 1).alias("child_task_id"), F.col("o_orderstatus").alias("relationship"))
    return G.children_of(own, relations, "P").select("parent_task_id", "child_task_id", "c_name")


_E = "e AS (SELECT p_partkey AS src, p_partkey + k AS dst FROM part, unnest([1, 4]) AS u(k))"


def _edges(spark, d):
    nodes = W.table(spark, d, "part")
    return nodes.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 4)).alias("dst"))


@_query("hr11_path", f"WITH RECURSIVE {_E}, p AS (SELECT 11::BIGINT AS node, [11::BIGINT] AS way UNION ALL SELECT e.dst, list_append(way, e.dst) FROM p JOIN e ON e.src = p.node WHERE len(way) < 5 AND e.dst <= 23), w AS (SELECT way FROM p WHERE node = 23 ORDER BY len(way), way LIMIT 1) SELECT cast(k - 1 AS INTEGER) AS step, way[k] AS node FROM w, unnest(range(1, len(way) + 1)) AS u(k)")
def _(spark, d):
    return G.path(_edges(spark, d), 11, 23)


@_query("hr11_edge_changes", f"WITH {_E} SELECT src, dst FROM e WHERE dst - src = 4 UNION ALL SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey <> 4")
def _(spark, d):
    edges = _edges(spark, d)
    kept = G.without_edges(edges, edges.filter("dst - src = 1"))
    return G.with_edges(kept, W.table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2).alias("dst")))


@_query("ag19_totals", "SELECT cast(sum(p_size % 7) AS BIGINT) AS total_concurrency, sum(p_size * 0.25) AS total_rpm_share, count(CASE WHEN p_size % 7 > 4 THEN 1 END) AS n_over FROM (SELECT p_size::DOUBLE AS p_size FROM part)")
def _(spark, d):
    rows = W.table(spark, d, "part").select((F.col("p_size") % 7).alias("concurrency"), (F.col("p_size") * 0.25).alias("rpm_share"), F.lit(4).alias("max_concurrent"))
    return M.concurrency_totals(rows).withColumn("total_concurrency", F.col("total_concurrency").cast("long"))


@_query("ag20_30_latency", f"{_L} SELECT stage, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_errors, avg(duration) AS mean_duration FROM log GROUP BY 1")
def _(spark, d):
    return M.latency(W.log(spark, d), "stage")


@_query("ag17_error_distribution", f"{_L} SELECT 'e' || (seq % 3) AS error, count(*) AS n FROM log WHERE NOT ok GROUP BY 1")
def _(spark, d):
    return M.error_distribution(W.log(spark, d).withColumn("error", F.concat(F.lit("e"), (F.col("seq") % 3).cast("string"))))


@_query("ag17_success_rate", f"{_L} SELECT count(*) AS total, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_errors, count(CASE WHEN ok THEN 1 END) / count(*) AS success_rate FROM log")
def _(spark, d):
    return M.success_rate(W.log(spark, d))


@_query("ag21_daily", f"{_L} SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_errors, cast(sum(duration) AS BIGINT) AS sum_duration, cast(sum(seq % 100) AS BIGINT) AS tokens, sum((seq % 8)::DOUBLE * 0.5) AS cost FROM log GROUP BY 1")
def _(spark, d):
    return M.periods(W.log(spark, d).withColumn("tokens", F.col("seq") % 100).withColumn("cost", F.col("seq") % 8 * 0.5), "day")


_A = "a AS (SELECT 'type' || s_suppkey AS task_type, (s_suppkey % 5) * 0.25 AS rpm_share, s_suppkey % 4 AS max_concurrent, s_suppkey * 10 AS interval_ms FROM supplier)"


def _allocations(spark, d):
    k = F.col("s_suppkey")
    return W.table(spark, d, "supplier").select(F.concat(F.lit("type"), k.cast("string")).alias("task_type"), (k % 5 * 0.25).alias("rpm_share"), (k % 4).alias("max_concurrent"), (k * 10).alias("interval_ms"))


@_query("ag28_config_report", f"WITH {_A} SELECT task_type, (rpm_share * 60)::DOUBLE AS rpm, max_concurrent, concat_ws(',', CASE WHEN rpm_share <= 0 OR rpm_share > 1 THEN 'share' END, CASE WHEN max_concurrent <= 0 THEN 'concurrent' END, CASE WHEN interval_ms <= 0 THEN 'interval' END) AS errors, interval_ms < 100 AS short_interval FROM a")
def _(spark, d):
    return M.config_report(_allocations(spark, d), 60, 10).withColumn("errors", F.array_join("errors", ","))


@_query("ag28_config_warnings", f"WITH {_A} SELECT sum(rpm_share)::DOUBLE AS total_share, cast(sum(max_concurrent) AS BIGINT) AS total_concurrent, sum(rpm_share) > 1 AS share_over, sum(max_concurrent) > 10 AS concurrent_over, sum(rpm_share) > 0.8 AS high_share, sum(max_concurrent) > 8 AS high_concurrent FROM a")
def _(spark, d):
    return M.config_warnings(_allocations(spark, d), 10)


@_query("fn29_semantic", f"SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_partkey ELSE p_name END AS name, 'semantic_transform' AS source, CASE WHEN p_partkey % 3 = 0 THEN 'pdf' END AS selected_from FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    choices = W.table(spark, d, "part").select(k.alias("pos"), k.cast("string").alias("code"), F.col("p_name").alias("rule_name"), F.lit(0.5).alias("rule_confidence"), F.lit("").alias("parent_code"), F.lit("").alias("level"))
    reply = F.when(k % 3 == 0, F.concat(F.lit('{"name": "new '), k.cast("string"), F.lit('", "selected_from": "pdf"}'))).when(k % 3 == 1, "not json").otherwise('{"name": 7}')
    return R.transformed(choices, W.table(spark, d, "part").select(k.alias("pos"), reply.alias("answer"))).select("pos", "name", "source", "selected_from")


@_query("fn30_from_pdf", f"{_P} SELECT code, name, 'pdf_direct' AS source, 'data_mapper' AS processed_by FROM found")
def _(spark, d):
    _, found = W.rule_and_pdf(spark, d)
    return R.from_pdf(found.withColumns({"level": F.lit(""), "confidence": F.lit(0.5)})).select("code", "name", "source", "processed_by")


@_query("sm14_st04_staged", f"{_TAX} SELECT string_split(code, '-')[1] AS prefix, code, name FROM tax WHERE seq % 5 <> 0")
def _(spark, d):
    items = W.tax(spark, d).withColumn("name", F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "name", F.lit("\t"))))
    twice = items.unionByName(items.withColumns({"seq": F.col("seq") + 10**12, "name": F.lit("later")}).filter("seq % 5 <> 0"))
    return R.staged(twice).select("prefix", "code", "name")


@_query("snk01_stamped", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 9 END AS batch_id, 20240101 AS batch_ts, true AS is_current FROM orders")
def _(spark, d):
    return V.stamped(W.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 7).alias("batch_id")), 9, 20240101)


@_query("snk05_blocks_insert", f"{_B} SELECT task_id, page_num, block_num, md5(text) AS hash FROM blocks")
def _(spark, d):
    path = folders.new(spark, "blocks")
    rows = _blocks(spark, d)
    sinks.appended(rows, path)
    folders.deleted_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path).select("task_id", "page_num", "block_num", F.md5("text").alias("hash"))


@_query("flt17_errors_by_type", f"{_TAX}, {_BAD} SELECT code FROM bad WHERE NOT regexp_matches(code, '^[0-9]+(-[0-9]+)*$')")
def _(spark, d):
    return D.by_type(H.validated(_bad(spark, d).withColumn("level", codes.level_of(F.col("code")))), "code:format").select("code")


@_query("ux04_rules", f"{_TAX}, {_BAD} SELECT seq, concat_ws(',', CASE WHEN name = '' THEN 'has_name' END, CASE WHEN NOT regexp_matches(code, '^[0-9]+(-[0-9]+)*$') THEN 'valid_code' END) AS violations FROM bad")
def _(spark, d):
    rules = {"has_name": text.has_value(F.col("name")), "valid_code": codes.is_valid_code(F.col("code"))}
    return registry.violations(_bad(spark, d), rules).select("seq", F.array_join("violations", ",").alias("violations"))


@_query("ux03_factories", f"WITH {W.CELLS_SQL}, l AS (SELECT row_idx, len(string_split(e, chr(10))) AS c, len(string_split(f, chr(10))) AS m FROM cells WHERE NOT junk AND n > 5 AND e <> '' AND f <> '') SELECT cast(sum(least(c, m)) AS BIGINT) AS n FROM l")
def _(spark, d):
    return registry.PARSERS.create("details")(W.cells(spark, d)).agg(_N())


@_query("vd03_page_info", "SELECT source AS doc, doc_id + 1 AS page_number, length(coalesce(text, '')) AS text_length, doc_id % 2 = 0 AS has_images FROM documents")
def _(spark, d):
    pages = _pages(spark, d).withColumn("images", F.when(F.col("page_num") % 2 == 0, F.array(F.lit(1))))
    return D.page_info(pages).select("doc", "page_number", F.col("text_length").cast("long").alias("text_length"), "has_images")


@_query("vd05_access_integrity", "SELECT c_custkey AS doc, n IS NOT NULL AS has_structure, CASE WHEN n IS NULL THEN 'no structure' ELSE '' END AS issues, c_custkey % 3 <> 0 AS is_complete FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, d):
    docs = W.table(spark, d, "customer").select(F.col("c_custkey").alias("doc"))
    entries = W.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("level"))
    whole = D.integrity(docs.withColumn("error", F.when(F.col("doc") % 3 == 0, "unreadable")))
    return D.accessibility(D.structure(docs, entries)).join(whole, "doc").select("doc", "has_structure", F.array_join("issues", ",").alias("issues"), "is_complete")


@_query("ag26_match_counts", f"{_P} SELECT count(CASE WHEN hit THEN 1 END) AS n_matched, count(CASE WHEN NOT hit THEN 1 END) AS n_unmatched FROM (SELECT code IN (SELECT code FROM found) OR name IN (SELECT name FROM found) AS hit FROM rules)")
def _(spark, d):
    return R.match_counts(*W.rule_and_pdf(spark, d))


@_query("ag27_graph_statistics", f"{_TAX} SELECT (SELECT count(*) FROM tax) AS n_nodes, cast((SELECT count(*) FROM tax WHERE parent <> '') AS BIGINT) AS n_edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM tax WHERE parent <> '' GROUP BY parent)) AS max_degree, (SELECT count(*) FROM tax WHERE code NOT IN (SELECT parent FROM tax)) AS n_leaves, cast((SELECT count(*) FROM tax WHERE parent <> '') AS DOUBLE) / (SELECT count(*) FROM tax) AS avg_degree, cast((SELECT count(*) FROM tax WHERE parent <> '') AS DOUBLE) / ((SELECT count(*) FROM tax) * (SELECT count(*) - 1 FROM tax)::DOUBLE) AS density")
def _(spark, d):
    rows = W.tax(spark, d).select("code", codes.parent_code(F.col("code")).alias("parent"))
    return G.statistics(rows.select(F.col("code").alias("node")), rows.filter("parent <> ''").select(F.col("parent").alias("src"), F.col("code").alias("dst")))


@_query("hr11_components", "SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // 10 * 10 + 1 END AS component FROM part")
def _(spark, d):
    nodes = W.table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return G.components(nodes, nodes.filter("node % 10 <> 0").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(nodes, F.col("dst") == F.col("node"), "left_semi"))


@_query("hr12_breadth_first", f"{_DEPTH} SELECT code, cast(depth AS INTEGER) AS depth FROM depths")
def _(spark, d):
    return H.breadth_first(_tree(spark, d)).select("code", "depth")


@_query("hr12_level_and_find", f"{_DEPTH} SELECT code, 'level' AS how FROM depths WHERE depth = 2 UNION ALL SELECT code, 'find' FROM depths WHERE name = '1-URGENT' AND code LIKE '%7'")
def _(spark, d):
    tree = _tree(spark, d)
    hits = H.found(tree, F.col("name") == "1-URGENT", F.col("code").like("%7"))
    return H.at_level(tree, 2).select("code", F.lit("level").alias("how")).unionByName(hits.select("code", F.lit("find").alias("how")))


@_query("wn05_font_rank", f"{_B}, r AS (SELECT DISTINCT task_id, font_size, dense_rank() OVER (PARTITION BY task_id ORDER BY font_size DESC) AS k FROM blocks) SELECT task_id, cast(font_size AS DOUBLE) AS font_size, least(CASE WHEN k > 3 THEN 4 ELSE k END, 4) AS level FROM r")
def _(spark, d):
    return B.size_levels(W.blocks(spark, d)).withColumn("level", F.col("level").cast("long"))


@_query("wn14_round_robin", f"{_T} SELECT queue, CASE (k - 1) % 2 WHEN 0 THEN 'rule' ELSE 'pdf' END AS kind, count(*) AS n FROM (SELECT queue, row_number() OVER (PARTITION BY queue ORDER BY task_id) AS k FROM tasks) GROUP BY ALL")
def _(spark, d):
    return M.round_robin(W.tasks(spark, d), "queue", "task_id", ("rule", "pdf")).groupBy("queue", "kind").agg(_N())


@_query("tk02_recent_tasks", f"{_T} SELECT task_id FROM tasks ORDER BY created DESC, task_id LIMIT 10")
def _(spark, d):
    return V.page(W.tasks(spark, d), [F.desc("created"), "task_id"], V.recent_limit(None)).select("task_id")


@_query("tk03_blocks_page", f"{_B} SELECT page_num, block_num FROM blocks ORDER BY task_id, page_num, block_num LIMIT 100 OFFSET 50")
def _(spark, d):
    return B.page_of(W.blocks(spark, d), 100, 50).select("page_num", F.col("block_num").cast("long").alias("block_num"))


@_query("tk11_tasks_page", f"{_T} SELECT task_id, (SELECT count(*) FROM tasks WHERE queue = 'user') AS total FROM tasks WHERE queue = 'user' ORDER BY created DESC, task_id LIMIT 20 OFFSET 20")
def _(spark, d):
    return K.page_of(W.tasks(spark, d).filter("queue = 'user'"), [F.desc("created"), "task_id"], 20, 20).select("task_id", "total")


@_query("tk13_occupation_codes", f"{_B} SELECT page_num, cast(block_num AS INTEGER) AS block_num, code FROM blocks WHERE code IS NOT NULL")
def _(spark, d):
    return B.codes_in_order(_blocks(spark, d)).select("page_num", "block_num", F.col("occupation_code").alias("code"))


_PROVIDERS = "pr AS (SELECT s_name AS name, s_acctbal > 0 AS available FROM supplier)"


def _providers(spark, d):
    return W.table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("available"))


@_query("tk15_first_available", f"""WITH {_PROVIDERS}, t AS (SELECT c_custkey AS task_id, unnest([1, 2, 3]) AS k, unnest([c_custkey % 90 + 1, c_custkey % 70 + 5, c_custkey % 50 + 9]) AS s FROM customer),
n AS (SELECT task_id, k, 'Supplier#' || lpad(cast(s AS VARCHAR), 9, '0') AS name FROM t) SELECT c_custkey AS task_id, coalesce(p.provider, 'none') AS provider FROM customer LEFT JOIN (SELECT task_id, arg_min(name, k) AS provider FROM n JOIN pr USING (name) WHERE available GROUP BY 1) p ON p.task_id = c_custkey""")
def _(spark, d):
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    tasks = W.table(spark, d, "customer").select(k.alias("task_id"), F.array(name(k % 90 + 1), name(k % 70 + 5), name(k % 50 + 9)).alias("providers"))
    return M.first_available(tasks, _providers(spark, d), "none").select("task_id", "provider")


@_query("tk16_list_providers", f"WITH {_PROVIDERS} SELECT name FROM pr")
def _(spark, d):
    return M.provider_names(_providers(spark, d))


@_query("ux06_weighted_routing", "SELECT s_nationkey, arg_min(s_name, (-(s_suppkey % 7 * 2.0 + s_suppkey % 5 * 3.0)::DOUBLE, s_name)) AS name, max(s_suppkey % 7 * 2.0 + s_suppkey % 5 * 3.0)::DOUBLE AS score FROM supplier GROUP BY 1")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = W.table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("name"), (k % 7).alias("cost"), (k % 5).alias("speed"))
    return M.best_provider(rows, "s_nationkey", {"cost": 2.0, "speed": 3.0})


@_query("st02_union_distinct", f"{_P} SELECT code FROM rules UNION SELECT code FROM found")
def _(spark, d):
    rules, found = W.rule_and_pdf(spark, d)
    return rules.select("code").union(found.select("code")).distinct()


@_query("st05_distinct_fonts", f"{_B} SELECT DISTINCT font, cast(font_size AS DOUBLE) AS font_size FROM blocks")
def _(spark, d):
    return B.distinct_fonts(W.blocks(spark, d))


@_query("gn05_page_text", "SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY 1")
def _(spark, d):
    turns = W.table(spark, d, "conversations").select(F.lit("t").alias("task_id"), F.col("conv_id").alias("page_num"), F.col("turn").alias("block_num"), "text")
    return B.page_texts(turns).select(F.col("page_num").alias("conv_id"), F.md5("text").alias("hash"))


@_query("sm02_too_soon", f"{_L}, g AS (SELECT seq, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY stage ORDER BY seq) AS gap FROM log) SELECT seq, gap FROM g WHERE gap < 300")
def _(spark, d):
    return M.too_soon(W.log(spark, d), 300).select("seq", "gap")


@_query("sm05_ttl_cleanup", "WITH s AS (SELECT user_id AS task_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY 1) SELECT task_id, status FROM s WHERE NOT (status = 'error' AND ts < TIMESTAMP '2024-01-20')")
def _(spark, d):
    events = W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), "ts", F.col("event_type").alias("status"))
    ended = S.latest_states(events).withColumn("status", F.when(F.col("status") == "error", "failed").otherwise(F.col("status")))
    return S.kept(ended.withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-20 00:00:00", 0).select("task_id", F.when(F.col("status") == "failed", "error").otherwise(F.col("status")).alias("status"))


@_query("sm06_window_counts", "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return S.window_counts(W.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("hr08_tree_errors", f"""{_TAX}, {_BAD}, b AS (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq) = 1) SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN code = '' THEN 'code:required' END, CASE WHEN name = '' THEN 'name:required' END,
  CASE WHEN {_DASHES} > 3 THEN 'level:enum' END, CASE WHEN NOT regexp_matches(code, '^[0-9]+(-[0-9]+)*$') THEN 'code:format' END]) AS error FROM b) WHERE error IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return H.validated(H.built(_bad(spark, d))).groupBy("error").agg(_N())


@_query("flt10_font_sizes", f"{_B} SELECT task_id, count(*) AS n FROM blocks WHERE font_size BETWEEN 9 AND 10 GROUP BY 1")
def _(spark, d):
    return B.filtered(_blocks(spark, d), sizes=(9, 10)).groupBy("task_id").agg(_N())

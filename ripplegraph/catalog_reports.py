"""Queries that run reports, options, entries and the engine over results and facts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ripplegraph.catalog import flag_rank, node, page_paths, query
from ripplegraph.catalog_cases import Cases, cat, fact, note
from ripplegraph.functions import text
from ripplegraph.model import FACTS, Options
from ripplegraph.operators import extractors, reports, resources
from ripplegraph.plans import engine
from ripplegraph.plans.engine import Engine, Result, facts_of
from ripplegraph.sources import batch, config, settings
from ripplegraph.storage import materialize, read

KINDS = ("MYSQL", "REDIS", "KAFKA", "RABBITMQ", "ROCKETMQ", "EXTERNAL_HTTP")


def order_result(spark, d) -> Result:
    """Each order a result, its lines methods, edges and resources."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    root = cat("O", "$l_orderkey").alias("root_id")
    entries = o.select(cat("O", "$o_orderkey").alias("root_id"), F.lit("HTTP").alias("type"), cat("GET /o/", "$o_orderkey").alias("display"), F.lit("GET").alias("http_method"), cat("m", "$o_orderkey").alias("method_key"))
    methods = li.select(root, cat("P", "$l_partkey").alias("method_key"), F.col("l_linenumber").alias("depth"), F.array("l_returnflag").alias("path"), F.lit("p").alias("project"), cat("a.P", "$l_partkey", ".run").alias("label"), F.lit(True).alias("is_project_source"))
    edges = li.select(root, cat("O", "$l_orderkey").alias("caller"), cat("P", "$l_partkey").alias("callee"), flag_rank().alias("conf_rank"), F.lit("call").alias("reason"), F.col("l_linenumber").alias("ord"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    found = li.select(root, F.col("l_linenumber").alias("ord"), kind.alias("type"), cat("n|", "$l_partkey").alias("name"), F.when(F.col("l_linestatus") == "F", "WRITE").otherwise("READ").alias("operation"), flag_rank().alias("conf_rank"), cat('say "', "$l_linenumber", '"').alias("detail"))
    message = F.when(F.col("o_orderstatus") == "F", cat("无法解析调用：f", "$o_custkey", "()")).otherwise("无法解析方法引用：Order::new")
    warnings = o.select(cat("O", "$o_orderkey").alias("root_id"), message.alias("message"))
    return Result(entries, methods, edges, found, warnings)


def order_batch(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "SUCCESS").when(s == "F", "FAILED").otherwise("SKIPPED")
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("idx"), cat("O", "$o_orderkey").alias("input"), status.alias("status"), F.when(s != "O", cat("why ", s)).alias("reason"), F.when(s == "O", cat("P", "$o_custkey")).alias("method_key"))


LINES = """l AS (SELECT 'O' || l_orderkey AS root_id, l_linenumber AS ord, ['MYSQL', 'REDIS', 'KAFKA', 'RABBITMQ', 'ROCKETMQ', 'EXTERNAL_HTTP'][l_linenumber % 6 + 1] AS type,
  ['MySQL', 'Redis', 'Kafka', 'RabbitMQ', 'RocketMQ', '外围接口'][l_linenumber % 6 + 1] AS type_label, 'n|' || l_partkey AS name, CASE WHEN l_linestatus = 'F' THEN 'WRITE' ELSE 'READ' END AS operation,
  CASE WHEN l_linenumber % 6 = 5 AND l_linestatus <> 'F' THEN '查询' WHEN l_linestatus = 'F' THEN '写入' ELSE '只读' END AS op, CASE l_returnflag WHEN 'A' THEN '已确认' WHEN 'N' THEN '推断' ELSE '待确认' END AS conf, 'say ""' || l_linenumber || '""' AS detail FROM lineitem)"""


@query(f"""WITH {LINES} SELECT root_id, '"HTTP","GET /o/' || substr(root_id, 2) || '","' || type_label || '","' || name || '","' || op || '","' || conf || '","' || detail || '"' AS line FROM l""")
def q_detail_csv(spark, d):
    """SK-1, S-38, S-43: a line of the detail report for each resource."""
    return reports.detail_csv(order_result(spark, d)).select("root_id", "line")


@query(f"""WITH {LINES}, m AS (SELECT 'O' || l_orderkey AS root_id, COUNT(DISTINCT l_partkey) AS methods, COUNT(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, 'O' || o_orderkey AS input, o_custkey, CASE o_orderstatus WHEN 'O' THEN '成功' WHEN 'F' THEN '失败' ELSE '跳过' END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'why ' || o_orderstatus ELSE '' END AS reason, o_orderstatus FROM orders),
a AS (SELECT DISTINCT 'O' || l_orderkey AS input, l_partkey FROM lineitem)
SELECT CAST(k AS INT) AS idx, '"' || k || '","' || b.input || '","' || status || '","' || reason || '","GET","GET /o/' || k || '","' || CASE WHEN a.l_partkey IS NULL THEN '' ELSE 'a.P' || a.l_partkey || '.run' END || '","' || COALESCE(m.methods, 0) || '","' || COALESCE(m.n, 0) || '","' ||
COALESCE(type_label, '') || '","' || COALESCE(name, '') || '","' || COALESCE(op, '') || '","' || COALESCE(conf, '') || '","' || COALESCE(detail, '') || '"' AS line
FROM b LEFT JOIN l ON l.root_id = b.input LEFT JOIN m ON m.root_id = b.input LEFT JOIN a ON a.input = b.input AND a.l_partkey = o_custkey AND o_orderstatus = 'O'""")
def q_outer_explode(spark, d):
    """SK-4, S-42: a line of the batch report for each resource, and one for a row without any."""
    result = order_result(spark, d)
    once = Result(result.entries, result.methods.dropDuplicates(["root_id", "method_key"]), result.edges, result.resources, result.warnings)
    return reports.batch_csv(order_batch(spark, d), once).select("idx", "line")


@query("""WITH m AS (SELECT 'O' || l_orderkey AS root_id, COUNT(DISTINCT l_partkey) AS methods, COUNT(*) AS resources, CASE WHEN bool_or(l_returnflag = 'R') THEN '待确认' ELSE '已完成' END AS status FROM lineitem GROUP BY 1)
SELECT root_id, methods, resources, 1 AS warnings, status FROM m JOIN orders ON 'O' || o_orderkey = root_id""")
def q_status_counts(spark, d):
    """A-10 to A-12, SK-12: methods, resources, warnings and the status of each result."""
    return reports.counts(order_result(spark, d))


CELL = "COALESCE(string_agg({1}, chr(10) ORDER BY ord, {1}) FILTER ({0}), '无')"


@query(f"""WITH {LINES}, c AS (SELECT root_id, COUNT(*) FILTER (type = 'MYSQL') AS n, {CELL.format("type = 'MYSQL' AND operation = 'WRITE'", "name")} AS w, {CELL.format("type = 'MYSQL' AND operation = 'READ'", "name")} AS r, {CELL.format("type = 'REDIS'", "name")} AS redis,
{", ".join(f'''{CELL.format(f"type = '{k}'", "op || '：' || name")} AS {k.lower()}''' for k in KINDS[2:])} FROM l GROUP BY root_id)
SELECT root_id, CASE WHEN n = 0 THEN '无' ELSE '写入：' || w || chr(10) || '只读：' || r END AS mysql, redis, kafka, rabbitmq, rocketmq, external_http FROM c""")
def q_type_pivot(spark, d):
    """A-9, A-13 to A-16: the names of each type by operation, as cells."""
    return reports.summaries(order_result(spark, d), False).drop("open", "writes", "reads")


@query(f"WITH {LINES} SELECT root_id, ord, name FROM l WHERE type = 'KAFKA' AND contains(name, '|1') AND operation = 'READ'")
def q_ui_filter(spark, d):
    """P-24, O-2: resources of a type, with a part of a name in any case, of an operation, sorted."""
    return reports.view(order_result(spark, d).resources, "KAFKA", "N|1", "READ", ["name", "root_id", "ord"]).select("root_id", "ord", "name")


@query("""WITH e AS (SELECT 'O' || l_orderkey AS root_id, 'P' || l_partkey AS callee, MIN(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2)
SELECT root_id, root_id AS caller, string_agg(callee, ',' ORDER BY ord, callee) AS callees FROM e GROUP BY 1""")
def q_adjacency(spark, d):
    """A-20: the callees of each caller, in the order of the calls."""
    return reports.adjacency(order_result(spark, d).edges).select("root_id", "caller", F.array_join("callees", ",").alias("callees"))


@query("""WITH r AS (SELECT 'P:' || l_partkey AS name, CASE WHEN l_linestatus = 'F' THEN 'WRITE' ELSE 'READ' END AS operation, l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c FROM lineitem)
SELECT 'MYSQL' AS type, name, operation, MAX(c) AS conf_rank, string_agg(DISTINCT 'O:' || l_orderkey, chr(10) || '---' || chr(10) ORDER BY 'O:' || l_orderkey) AS detail, arg_min('s' || l_orderkey, 'O:' || l_orderkey) FILTER (l_orderkey % 3 = 0) AS source FROM r GROUP BY name, operation""")
def q_merge_resources(spark, d):
    """A-4 to A-7: one row a resource, least certain confidence, all evidence, the first source that is known."""
    from ripplegraph.catalog import resource_rows

    key = F.regexp_extract("detail", r"(\d+)", 1).cast("long")
    rows = resource_rows(spark, d).withColumn("source", F.when(key % 3 == 0, cat("s", key.cast("string"))))
    return resources.merge(rows).drop("ord")


# ---- small results -----------------------------------------------------------------------------------


def region_result(spark, d) -> Result:
    """Each region a result, its nations methods and resources."""
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    root = cat("/r/", "$n_regionkey").alias("root_id")
    entries = r.select(cat("/r/", "$r_regionkey").alias("root_id"), F.lit("HTTP").alias("type"), cat("GET /r/", "$r_regionkey").alias("display"), F.lit("GET").alias("http_method"), F.col("r_name").alias("method_key"))
    own = entries.select("root_id", "method_key", F.lit(0).alias("depth"), F.array("method_key").alias("path"), F.lit("p").alias("project"), F.concat(F.lit("a."), "method_key").alias("label"), F.lit(True).alias("is_project_source"))
    methods = own.unionByName(n.select(root, F.col("n_name").alias("method_key"), F.lit(1).alias("depth"), F.array("n_name").alias("path"), F.lit("p").alias("project"), F.concat(F.lit("a."), "n_name").alias("label"), F.lit(True).alias("is_project_source")))
    edges = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(root, F.col("r_name").alias("caller"), F.col("n_name").alias("callee"), F.lit(1).alias("conf_rank"), F.lit("call").alias("reason"), F.col("n_nationkey").alias("ord"))
    found = n.select(root, F.col("n_nationkey").alias("ord"), F.lit("MYSQL").alias("type"), F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "WRITE").otherwise("READ").alias("operation"), (F.col("n_nationkey") % 3).cast("int").alias("conf_rank"), F.lit("d").alias("detail"))
    warnings = r.filter("r_regionkey % 2 = 0").select(cat("/r/", "$r_regionkey").alias("root_id"), F.lit("a|b").alias("message"))
    return Result(entries, methods, edges, found, warnings)


def region_batch(spark, d):
    bad = F.col("r_regionkey") == 3
    return read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("idx"), cat("/r/", "$r_regionkey").alias("input"), F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), F.when(bad, "out of luck").alias("reason"), F.when(~bad, F.col("r_name")).alias("method_key"))


HASH = """WITH RECURSIVE h(name, rest, v) AS (SELECT name, name, 0::BIGINT FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) UNION ALL SELECT name, substr(rest, 2), (v * 31 + unicode(rest[1])) % 4294967296 FROM h WHERE rest <> ''),
i AS (SELECT name, 'n' || lower(to_hex(v)) AS id FROM h WHERE rest = '')"""


@query(f"""{HASH}, r AS (SELECT *, 'resource_' || substr(md5('MYSQL|' || lower(n_name) || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'WRITE' ELSE 'READ' END || '|d'), 1, 12) AS rid FROM nation)
SELECT '/r/' || r_regionkey AS root_id, 0 AS part, '  ' || id || '["p：a.' || r_name || '"]' AS line FROM region JOIN i ON name = r_name
UNION ALL SELECT '/r/' || n_regionkey, 0, '  ' || id || '["p：a.' || n_name || '"]' FROM nation JOIN i ON name = n_name
UNION ALL SELECT '/r/' || n_regionkey, 1, '  ' || a.id || ' -->|推断| ' || b.id FROM nation JOIN region ON r_regionkey = n_regionkey JOIN i a ON a.name = r_name JOIN i b ON b.name = n_name
UNION ALL SELECT '/r/' || n_regionkey, 2, '  ' || rid || '[("MySQL: ' || lower(n_name) || '")]' FROM r
UNION ALL SELECT '/r/' || n_regionkey, 3, '  ' || id || ' -.-> ' || rid FROM r JOIN region ON r_regionkey = n_regionkey JOIN i ON name = r_name""")
def q_mermaid_lines(spark, d):
    """SK-3, J-20, S-39, S-41: nodes, edges and resources as lines of a diagram."""
    return reports.mermaid(region_result(spark, d)).select("root_id", "part", "line")


NATIONS = """w AS (SELECT n_regionkey AS k, COALESCE(string_agg('`' || lower(n_name) || '`', '<br>' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0), '无') AS w, COALESCE(string_agg('`' || lower(n_name) || '`', '<br>' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1), '无') AS r,
  bool_or(n_nationkey % 3 = 2) AS open, COUNT(*) AS n FROM nation GROUP BY 1)"""


@query(f"""WITH {NATIONS}, c AS (SELECT k, string_agg(l, ' -> ' ORDER BY d, l) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, l) AS x FROM (SELECT r_regionkey AS k, 0 AS d, 'p：a.' || r_name AS l FROM region UNION ALL SELECT n_regionkey, 1, 'p：a.' || n_name FROM nation)) WHERE x <= 8 GROUP BY k)
SELECT '/r/' || k AS root_id, '| HTTP | `GET /r/' || k || '` | ' || CASE WHEN open THEN '待确认' ELSE '已完成' END || ' | ' || chain || ' | 写入：' || w || '<br>只读：' || r || ' | 无 | 无 | 无 | 无 | 无 | 无 | 无 |' AS line FROM w JOIN c USING (k)""")
def q_top_n_methods(spark, d):
    """SK-5, O-3, S-37: one line of the overview for each result, its chain the first eight methods."""
    return reports.overview(region_result(spark, d))


@query(f"""WITH {NATIONS}, b AS (SELECT r_regionkey AS k, r_regionkey = 3 AS bad, r_name FROM region), t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (NOT bad) AS ok FROM b), x AS (
SELECT 0 AS part, 0 AS k, '# 批量统计' AS line UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, '## 总览' UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, '- 总输入数：' || n FROM t UNION ALL SELECT 5, 0, '- 成功：' || ok FROM t UNION ALL SELECT 6, 0, '- 跳过：0' UNION ALL SELECT 7, 0, '- 失败：' || (n - ok) FROM t
UNION ALL SELECT 8, 0, '' UNION ALL SELECT 9, 0, '## 接口结果' UNION ALL SELECT 10, 0, '' UNION ALL SELECT 11, 0, '| 序号 | 输入URL | 状态 | 原因 | HTTP方法 | 入口 | 分析方法 | 方法数 | 资源数 |' UNION ALL SELECT 12, 0, '|---|---|---|---|---|---|---|---|---|'
UNION ALL SELECT 13, b.k, '| ' || b.k + 1 || ' | `/r/' || b.k || '` | ' || CASE WHEN bad THEN '失败 | out of luck' ELSE '成功 | 无' END || ' | GET | GET /r/' || b.k || ' | ' || CASE WHEN bad THEN '无' ELSE 'a.' || r_name END || ' | ' || n + 1 || ' | ' || n || ' |' FROM b JOIN w USING (k)
UNION ALL SELECT 14, 0, '' UNION ALL SELECT 15, 0, '## 资源汇总' UNION ALL SELECT 16, 0, '' UNION ALL SELECT 17, 0, '| 序号 | 输入URL | MySQL | Redis | Kafka | RabbitMQ | RocketMQ | 外围接口 | 警告 |' UNION ALL SELECT 18, 0, '|---|---|---|---|---|---|---|---|---|'
UNION ALL SELECT 19, b.k, '| ' || b.k + 1 || ' | `/r/' || b.k || '` | 写入：' || w || '<br>只读：' || r || ' | 无 | 无 | 无 | 无 | 无 | ' || CASE WHEN b.k % 2 = 0 THEN 'a\\|b' ELSE '无' END || ' |' FROM b JOIN w USING (k) WHERE NOT bad
UNION ALL SELECT 20, 0, '' UNION ALL SELECT 21, 0, '## 跳过与失败明细' UNION ALL SELECT 22, 0, '' UNION ALL SELECT 23, k, '- ' || k + 1 || '. `/r/' || k || '`：失败，out of luck' FROM b WHERE bad)
SELECT row_number() OVER (ORDER BY part, k) - 1 AS at, line FROM x""".replace("\\\\", "\\"))
def q_batch_markdown(spark, d):
    """SK-6, P-30, S-37: the Markdown report of a batch, line by line."""
    lines = reports.batch_lines(region_batch(spark, d), region_result(spark, d))
    return lines.select((F.row_number().over(Window.orderBy("part", "idx")) - 1).cast("long").alias("at"), "line")


@query("""WITH w AS (SELECT n_regionkey AS k, COALESCE(string_agg(lower(n_name), chr(10) ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0), '无') AS w, COALESCE(string_agg(lower(n_name), chr(10) ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1), '无') AS r, COUNT(*) AS n FROM nation GROUP BY 1),
b AS (SELECT r_regionkey AS k, r_regionkey = 3 AS bad, r_name FROM region), t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (NOT bad) AS ok FROM b),
i AS (SELECT 2 AS sheet, k + 2 AS row, [CAST(k + 1 AS VARCHAR), '/r/' || k, CASE WHEN bad THEN '失败' ELSE '成功' END, CASE WHEN bad THEN 'out of luck' ELSE '无' END, 'GET', 'GET /r/' || k, CASE WHEN bad THEN '无' ELSE 'a.' || r_name END, CAST(n + 1 AS VARCHAR), CAST(n AS VARCHAR)] AS v FROM b JOIN w USING (k)),
s AS (SELECT 3 AS sheet, row_number() OVER (ORDER BY k) + 1 AS row, [CAST(k + 1 AS VARCHAR), '/r/' || k, '写入：' || w || chr(10) || '只读：' || r, '无', '无', '无', '无', '无', CASE WHEN k % 2 = 0 THEN 'a|b' ELSE '无' END] AS v FROM b JOIN w USING (k) WHERE NOT bad),
o AS (SELECT 1 AS sheet, row, v FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS row, unnest([['指标', '值'], ['总输入数', CAST(n AS VARCHAR)], ['成功', CAST(ok AS VARCHAR)], ['跳过', '0'], ['失败', CAST(n - ok AS VARCHAR)], ['执行状态', '扫描完成']]) AS v FROM t)),
h AS (SELECT 2 AS sheet, 1 AS row, ['序号', '输入URL', '状态', '原因', 'HTTP方法', '入口', '分析方法', '方法数', '资源数'] AS v UNION ALL SELECT 3, 1, ['序号', '输入URL', 'MySQL', 'Redis', 'Kafka', 'RabbitMQ', 'RocketMQ', '外围接口', '警告']),
a AS (SELECT sheet, row, v FROM i UNION ALL SELECT sheet, row, v FROM s UNION ALL SELECT * FROM o UNION ALL SELECT * FROM h)
SELECT CAST(sheet AS INT) AS sheet, chr(CAST(64 + c AS INT)) || row AS cell, v[c] AS value FROM (SELECT sheet, row, v, unnest(range(1, len(v) + 1)) AS c FROM a)""")
def q_batch_workbook(spark, d):
    """SK-7, S-41: the cells of the batch's workbook."""
    rows = reports.sheet_rows(region_batch(spark, d), region_result(spark, d))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("sheet").orderBy("at")))
    cells = rows.select("sheet", "row", F.posexplode("cells").alias("at", "value"))
    letter = F.element_at(F.array(*[F.lit(text.column_letters(i)) for i in range(len(reports.SUMMARY))]), F.col("at") + 1)
    return cells.select("sheet", F.concat(letter, F.col("row").cast("string")).alias("cell"), "value")


@query("""SELECT * FROM (VALUES (0, '"入口类型","入口","资源类型","资源名称","操作","置信度","调用路径与证据"'), (1, '"序号","输入URL","状态","跳过/失败原因","HTTP方法","入口","分析方法","方法数","资源数","资源类型","资源名称","操作","置信度","证据"'), (2, '/x/a.md'), (3, 'a.CSV')) t(place, value)""")
def q_headers(spark, d):
    """SK-2, SK-10, A-17: headers of the reports, after the mark of their encoding, and names of their files."""
    made = [reports.header(reports.DETAIL), reports.header(reports.BATCH)]
    rows = [v.removeprefix("﻿") if v.startswith("﻿") else "no mark" for v in made] + [reports.sibling("/x/a.csv", "md"), reports.sibling("a.CSV", "csv")]
    return spark.createDataFrame(list(enumerate(rows)), "place int, value string")


# ---- options, inputs, configuration ------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 7 ELSE CAST(least(greatest(c_custkey % 130, 1), 100) AS INT) END AS depth, CASE WHEN c_custkey % 3 = 1 THEN 's,t' ELSE 'x' || c_nationkey || '#,z' END AS patterns,
CASE WHEN c_custkey % 3 = 1 THEN 'a>far' ELSE 'a>n' || c_nationkey END AS mapped, 3 AS cross_depth FROM customer""")
def q_settings_table(spark, d):
    """SC-13, S-44, S-45: each project's own settings, or those of all projects where it says so; broken and missing ones as by default."""
    k = F.col("c_custkey")
    mine = {"use_shared": F.when(k % 3 == 1, "True").otherwise("false"), "max_depth": F.concat(F.lit(" "), (k % 130).cast("string")), "query_patterns": cat("x", "$c_nationkey", "#\r\n\n z "), "service_mappings": cat("a = b\n#c=d\na=n", "$c_nationkey", "\n=x\ny="), "max_cross_depth": F.lit("none")}
    rows = read(spark, d, "customer").select(k.cast("string").alias("project"), F.explode(F.create_map(*[x for n, v in mine.items() for x in (F.lit(n), v)])).alias("name", "value"))
    shared = spark.createDataFrame([("*", "max_depth", "7"), ("*", "query_patterns", "s\nt"), ("*", "service_mappings", "a=far")], "project string, name string, value string")
    entry = F.transform(F.map_entries("service_mappings"), lambda e: F.concat(e["key"], F.lit(">"), e["value"]))
    return settings.options(rows.unionByName(shared)).select(F.col("project").cast("long").alias("c_custkey"), F.col("max_depth").alias("depth"), F.array_join("query_patterns", ",").alias("patterns"), F.array_join(entry, ",").alias("mapped"), F.col("max_cross_depth").alias("cross_depth"))


@query("""SELECT s_suppkey, CAST(least(greatest(s_suppkey - 20, 1), 100) AS INT) AS depth, CAST(least(greatest(s_suppkey - 50, 1), 10) AS INT) AS cross_depth, CAST(least(greatest(s_suppkey * 2000 - 5000, 0), 86400) AS INT) AS timeout,
'java.,p' || s_nationkey || '.,' AS prefixes, s_suppkey % 2 = 0 AS merge FROM supplier""")
def q_option_clamp(spark, d):
    """S-44, SC-13, A-22: options within their ranges, from a project's settings or those of all projects."""
    k, i = F.col("s_suppkey"), lambda c: c.cast("string")
    mine = {"use_shared": F.lit("false"), "max_depth": i(k - 20), "max_cross_depth": i(k - 50), "row_timeout_seconds": i(k * 2000 - 5000), "excluded_prefixes": cat(" java. ,\np", "$s_nationkey", ".\r\n"), "merge_resources": i(k % 2 == 0)}
    rows = read(spark, d, "supplier").select(i(k).alias("project"), F.explode(F.create_map(*[x for n, v in mine.items() for x in (F.lit(n), v)])).alias("name", "value"))
    found = settings.options(rows)
    return found.select(F.col("project").cast("long").alias("s_suppkey"), F.col("max_depth").alias("depth"), F.col("max_cross_depth").alias("cross_depth"), F.col("row_timeout_seconds").alias("timeout"), F.concat(F.array_join("excluded_prefixes", ","), F.lit(",")).alias("prefixes"), F.col("merge_resources").alias("merge"))


@query("""SELECT n_nationkey, 'p' || n_regionkey AS target, n_nationkey % 2 = 1 AS changed FROM nation WHERE n_nationkey % 5 <> 0""")
def q_map_parse(spark, d):
    """S-45, A-22: mapping lines, comments left out; lists that differ only in order of blanks and repeats are the same."""
    n, k = read(spark, d, "nation"), F.col("n_nationkey")
    line = F.concat(F.when(k % 5 == 0, "# ").otherwise(" "), cat("svc", "$n_nationkey", " = p", "$n_regionkey", " "))
    texts = n.groupBy("n_regionkey").agg(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\r\n"), F.lit("\nno sign\n= x\ny =")).alias("raw"))
    found = texts.select(F.explode(settings.mappings(F.col("raw"))).alias("name", "target")).withColumn("n_nationkey", F.col("name").substr(4, 9).cast("int"))
    one = lambda *parts: F.create_map(F.lit("a"), cat(*parts))
    i = F.col("n_nationkey")
    other = F.when(i % 2 == 0, one("x", "$n_nationkey", "\r\ny,x", "$n_nationkey")).otherwise(one("x", "$n_nationkey", "\r\ny,z", "$n_nationkey"))
    return found.select("n_nationkey", "target", (F.size(settings.changed(one("x", "$n_nationkey", ", y\n"), other)) > 0).alias("changed"))


@query("SELECT n_nationkey, n_regionkey || '|' || n_name || '|z' AS items, 3 AS n FROM nation")
def q_list_option(spark, d):
    """S-44, A-22: lists of options by comma or line."""
    found = settings.items(cat("$n_regionkey", " ,\r\n ", "$n_name", "\n\n, z,z"), distinct=True)
    return read(spark, d, "nation").select("n_nationkey", F.array_join(found, "|").alias("items"), F.size(found).alias("n"))


PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query(rf"""WITH v AS (SELECT page_id AS line_no, trim({PATH}) AS value FROM pages WHERE {PATH} <> '') SELECT line_no, value, row_number() OVER (PARTITION BY value ORDER BY line_no) > 1 AND starts_with(value, '/') AND value <> '/' AND NOT regexp_matches(value, '\s') AND NOT contains(value, '://') AS duplicate FROM v""")
def q_dedup_inputs(spark, d):
    """A-19, O-5: inputs line by line, the first of a value kept, the others told as duplicates."""
    texts = page_paths(spark, d).select("page_id", F.concat("path", F.lit("\r\n \t\n")).alias("raw"))
    return batch.validate(batch.split_lines(texts), ("page_id", "line_no")).select(F.col("page_id").alias("line_no"), "value", "duplicate")


@query("""WITH c AS (SELECT n_regionkey AS k, arg_max(n_name, n_nationkey) AS v FROM nation GROUP BY 1), u AS (SELECT o_orderkey, o_custkey % 8 AS k, o_custkey % 2 = 0 AS has_default FROM orders)
SELECT o_orderkey, 'see ' || CASE WHEN v IS NOT NULL THEN v || ':' || u.k WHEN has_default THEN 'none' ELSE '${r.' || u.k || '}' END AS resolved FROM u LEFT JOIN c ON c.k = u.k""")
def q_config_resolve(spark, d):
    """J-15, G-5, S-16, A-21: the last value written for a key, through other keys, else the default, else the placeholder itself."""
    n = read(spark, d, "nation").orderBy("n_nationkey").collect()
    text = "\n".join([f"r.{r['n_regionkey']}=${{n.{r['n_regionkey']}}}:{r['n_regionkey']}\nn.{r['n_regionkey']}={r['n_name']}" for r in n])
    files = spark.createDataFrame([("p", 0, "a.properties", text)], "project string, ext_rank int, path string, text string")
    used = read(spark, d, "orders").select("o_orderkey", F.lit("p").alias("project"), cat("see ${r.", (F.col("o_custkey") % 8).cast("string"), F.when(F.col("o_custkey") % 2 == 0, ":none").otherwise(""), "}").alias("raw"))
    return config.resolve(used, config.key_values(files), "raw", "resolved").select("o_orderkey", "resolved")


@query(f"""WITH p AS (SELECT page_id, path, '/' || regexp_replace(regexp_replace(trim(path), '^/+|/+$', '', 'g'), '/+', '/', 'g') AS norm FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE trim(path, '/ ') <> '')
SELECT 'GET ' || a.norm AS display, a.path AS root_id, 'm' || b.page_id AS method_key FROM (SELECT DISTINCT path, norm FROM p) a JOIN p b ON a.norm = b.norm""")
def q_endpoint_join(spark, d):
    """P-1, P-6, S-1: paths meet the mapped methods in one hash join."""
    p = page_paths(spark, d).filter(F.trim(F.lit("/ "), "path") != "")
    key = cat("m", "$page_id")
    facts = facts_of(spark, {"method": fact(p, "method", method_key=key, class_fqn="a.A", name="m", param_types=[], modifiers=[], stmts=[]), "annotation": note(p, "method", key, "GetMapping", value=F.col("path"))})
    return engine.entries_at(p.select(F.col("path").alias("value")).distinct(), engine.endpoints(facts)).select("display", "root_id", "method_key")


# ---- the engine --------------------------------------------------------------------------------------


@query("""SELECT l_orderkey || '-' || l_linenumber AS call_id, 'P' || l_partkey AS callee_key, NULL AS message FROM lineitem WHERE l_partkey % 3 <> 0 AND l_returnflag <> 'N'
UNION ALL SELECT NULL, NULL, CASE WHEN l_returnflag = 'R' THEN '无法解析方法引用：' ELSE '无法解析调用：' END || 'x' || l_partkey FROM lineitem WHERE l_partkey % 3 = 0 AND l_returnflag <> 'N'""")
def q_method_ref_resolve(spark, d):
    """SC-3, P-11, J-1, J-2: calls and references whose method is known, a warning for each other; references to constructors (flag N) are neither."""
    li = read(spark, d, "lineitem")
    calls = fact(li, "call_site", call_id=cat("$l_orderkey", "-", "$l_linenumber"), caller_key="a", kind=F.when(F.col("l_returnflag") == "A", "call").otherwise("ref"), ref_name=F.when(F.col("l_returnflag") == "N", "new").otherwise("m"), callee_key=F.when(F.col("l_partkey") % 3 != 0, cat("P", "$l_partkey")), text=cat("x", "$l_partkey"))
    methods = fact(read(spark, d, "part"), "method", method_key=cat("P", "$p_partkey"), class_fqn="a", name="m", param_types=[], modifiers=[], stmts=[])
    known, missing = engine.resolved_calls(facts_of(spark, {"call_site": calls, "method": methods}))
    return known.select("call_id", "callee_key", F.lit(None).cast("string").alias("message")).unionByName(missing.select(F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("callee_key"), "message"))


@query("""WITH m AS (SELECT DISTINCT user_id % 50 AS root, event_type FROM events WHERE value > 60), c AS (SELECT DISTINCT event_type, user_id % 20 AS m FROM events), s AS (SELECT DISTINCT user_id % 50 AS root, user_id % 20 AS m FROM events WHERE value < 5)
SELECT 'r' || root AS root, 'x.' || event_type AS topic, 'c' || m AS node FROM m JOIN c USING (event_type) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.root = m.root AND s.m = c.m)""")
def q_mq_consumers_anti(spark, d):
    """J-6, J-7, P-29, U-5, G-3: consumers of produced topics that a walk hasn't met."""
    e = read(spark, d, "events")
    root, method = cat("r", (F.col("user_id") % 50).cast("string")), cat("c", (F.col("user_id") % 20).cast("string"))
    made = e.filter("value > 60").select(root.alias("root_id"), cat("x.", "$event_type").alias("topic")).distinct()
    eaten = e.select(cat("y.", "$event_type").alias("consumed"), method.alias("method_key")).distinct()
    seen = e.filter("value < 5").select(root.alias("root"), method.alias("node")).distinct()
    return engine.new_consumers(made, eaten, seen)


def mesh_facts(spark, d):
    """Two projects: a controller a region calls a producer a nation, whose topic a consumer listens to; each consumer calls a declared client of the other project."""
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    c = Cases(spark, "n_nationkey")
    c.add("project", c.once(), name="p", base_path="/p", is_open=True, is_indexing=False)
    c.add("project", c.once(), name="far", base_path="/far", is_open=True, is_indexing=False)
    ctl, pro, con, cli, far = (cat(f"{x}.", k) for x, k in (("ctl", "$r_regionkey"), ("pro", "$n_nationkey"), ("con", "$n_nationkey"), ("cli", "$n_nationkey"), ("far", "$n_nationkey")))
    key = c.method(r, ctl, "run")
    c.note(r, "class", ctl, "RequestMapping", value="/r")
    c.note(r, "method", key, "GetMapping", value=cat("", "$r_regionkey"))
    sender = c.method(n, pro, "send")
    c.add("call_site", n, call_id=cat("a", "$n_nationkey"), caller_key=cat("ctl.", "$n_regionkey", "#run"), callee_key=sender, text="send()")
    c.library("x.KafkaTemplate#send")
    c.add("call_site", n, call_id=cat("b", "$n_nationkey"), caller_key=sender, callee_key="x.KafkaTemplate#send", text="kafka()")
    c.add("call_arg", n, call_id=cat("b", "$n_nationkey"), expr_id=cat("e", "$n_nationkey"), type_fqn="s", type_args=[])
    c.add("expr", n, expr_id=cat("e", "$n_nationkey"), kind="literal", text="t", const_value=cat("topic.t", "$n_nationkey"), operands=[])
    eats = c.method(n, con, "eat")
    c.note(n, "method", eats, "KafkaListener", topics=cat("other.t", "$n_nationkey"))
    client = c.method(n, cli, "get", modifiers=["abstract"])
    c.add("call_site", n, call_id=cat("c", "$n_nationkey"), caller_key=eats, callee_key=client, text="get()")
    c.note(n, "class", cli, "FeignClient", name=F.when(F.col("n_nationkey") % 4 == 0, "unknown").otherwise("svc"))
    c.note(n, "method", client, "GetMapping", value=cat("/far/", "$n_nationkey"))
    end = c.method(n.filter("n_nationkey % 4 <> 1"), far, "serve", project="far")
    c.note(n.filter("n_nationkey % 4 <> 1"), "method", end, "GetMapping", value=cat("far/", "$n_nationkey"))
    c.add("call_site", n, call_id=cat("d", "$n_nationkey"), caller_key=eats, text=cat("lost", "$n_nationkey", "()"))
    return c.facts()


def mesh(spark, d) -> Result:
    made = Engine(mesh_facts(spark, d), Options(follow_cross_project=True, service_mappings={"svc": "far"}))
    asked = read(spark, d, "region").select(cat("/r/", "$r_regionkey").alias("value"))
    return made.analyze(made.by_path(asked))


@query("""SELECT '/r/' || n_regionkey AS root_id, 'ctl.' || n_regionkey || '#run' AS caller, 'pro.' || n_nationkey || '#send' AS callee, 0 AS conf_rank, 'PSI resolve' AS reason FROM nation
UNION ALL SELECT '/r/' || n_regionkey, 'pro.' || n_nationkey || '#send', 'x.KafkaTemplate#send', 0, 'PSI resolve' FROM nation
UNION ALL SELECT '/r/' || n_regionkey, 'ctl.' || n_regionkey || '#run', 'con.' || n_nationkey || '#eat', 1, '本地 MQ 消费者：topic.t' || n_nationkey FROM nation
UNION ALL SELECT '/r/' || n_regionkey, 'con.' || n_nationkey || '#eat', 'cli.' || n_nationkey || '#get', 0, 'PSI resolve' FROM nation""")
def q_engine_walk(spark, d):
    """G-2, G-3, G-16, J-5 to J-7, P-7, P-8, P-29, S-5: the edges of a walk that goes on from producers to their consumers."""
    return mesh(spark, d).edges.select("root_id", "caller", "callee", "conf_rank", "reason")


@query("""SELECT '/c/' || n_nationkey AS root_id, 'cli.' || n_nationkey || '#get' AS callee, 'PSI resolve' AS reason FROM nation UNION ALL SELECT '/c/' || n_nationkey, 'far.' || n_nationkey || '#serve', '跨工程 Feign：p -> far' FROM nation WHERE n_nationkey % 4 IN (2, 3)""")
def q_engine_hops(spark, d):
    """G-10, J-8 to J-10, SC-10, SC-12, P-2, P-33: entries by topic, and hops to the one endpoint of another project."""
    made = Engine(mesh_facts(spark, d), Options(follow_cross_project=True, service_mappings={"svc": "far"}, follow_local_consumers=False))
    topics = read(spark, d, "nation").select(cat("topic.t", "$n_nationkey").alias("value"))
    entries = made.by_topic(topics, mentions=False)
    number = F.regexp_extract("root_id", r"t(\d+)$", 1)
    return made.analyze(entries).edges.select(F.concat(F.lit("/c/"), number).alias("root_id"), "callee", "reason")


@query("""SELECT '/r/' || n_regionkey AS root_id, '无法解析调用：lost' || n_nationkey || '()' AS message FROM nation WHERE false
UNION ALL SELECT 'con.' || n_nationkey || '#eat', '无法解析调用：lost' || n_nationkey || '()' FROM nation
UNION ALL SELECT 'con.' || n_nationkey || '#eat', 'Feign unknown GET /far/' || n_nationkey || ' 未续链：未配置服务映射' FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'con.' || n_nationkey || '#eat', 'Feign svc GET /far/' || n_nationkey || ' 未续链：目标工程 far 未找到入口' FROM nation WHERE n_nationkey % 4 = 1""")
def q_warnings(spark, d):
    """A-2, G-16, J-2, P-30, P-31: the warnings of an analysis, each once."""
    made = Engine(mesh_facts(spark, d), Options(follow_cross_project=True, service_mappings={"svc": "far"}))
    keys = read(spark, d, "nation").select(cat("con.", "$n_nationkey", "#eat").alias("value"))
    return made.analyze(made.by_method(keys)).warnings


@query("""SELECT '/r/' || n_regionkey AS root_id, 'topic.t' || n_nationkey AS name, 'PRODUCE' AS operation, 1 AS conf_rank, '来源工程：p；调用路径：ctl.' || n_regionkey || '.run -> pro.' || n_nationkey || '.send -> x.KafkaTemplate.send；原始证据：x.KafkaTemplate.send' AS detail FROM nation
UNION ALL SELECT '/r/' || n_regionkey, 'other.t' || n_nationkey, 'CONSUME', 1, '来源工程：p；调用路径：ctl.' || n_regionkey || '.run -> con.' || n_nationkey || '.eat [推断分支]；原始证据：@KafkaListener' FROM nation
UNION ALL SELECT '/r/' || n_regionkey, 'other.t' || n_nationkey, 'CONSUME', 1, '来源工程：p；调用路径：ctl.' || n_regionkey || '.run -> con.' || n_nationkey || '.eat [推断分支] -> cli.' || n_nationkey || '.get；原始证据：@KafkaListener' FROM nation
UNION ALL SELECT '/r/' || n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown' ELSE 'svc' END || ' GET /far/' || n_nationkey, 'CALL', 1, '来源工程：p；调用路径：ctl.' || n_regionkey || '.run -> con.' || n_nationkey || '.eat [推断分支] -> cli.' || n_nationkey || '.get；原始证据：Feign FeignClient cli.' || n_nationkey || '.get' FROM nation""")
def q_engine_resources(spark, d):
    """G-11 to G-15, A-3, S-5, SC-1, SC-2: resources of a walk with their confidence, project, path and evidence."""
    return mesh(spark, d).resources.select("root_id", "name", "operation", "conf_rank", "detail")


@query("""SELECT 'f' || s_nationkey || ':' || (s_suppkey * 10 + 3) AS root_id, 'S' || s_suppkey AS method_key FROM supplier UNION ALL SELECT 'm' || s_suppkey || ':tag', 'S' || s_suppkey FROM supplier""")
def q_engine_entries(spark, d):
    """SC-11, P-2, SC-12: entries by position in a file, and by mention of a topic in a method's text."""
    s = read(spark, d, "supplier")
    key = cat("S", "$s_suppkey")
    method = fact(s, "method", method_key=key, class_fqn="a.A", name="m", param_types=[], modifiers=[], stmts=[], text=cat("send(m", "$s_suppkey", ");"))
    spans = fact(s, "method_span", path=cat("f", "$s_nationkey"), method_key=key, start=F.col("s_suppkey") * 10, end=F.col("s_suppkey") * 10 + 9)
    wide = fact(s.limit(0), "method_span")
    made = Engine(facts_of(spark, {"method": method, "method_span": spans.unionByName(wide)}), Options())
    at = s.select(cat("f", "$s_nationkey", ":", (F.col("s_suppkey") * 10 + 3).cast("string")).alias("value"), cat("f", "$s_nationkey").alias("path"), (F.col("s_suppkey") * 10 + 3).cast("int").alias("at"))
    topics = s.select(cat("m", "$s_suppkey", ":tag").alias("value"))
    found = made.by_topic(topics).filter(F.col("method_key") == F.regexp_replace(F.regexp_replace("root_id", ":tag$", ""), "^m", "S"))
    return made.by_position(at).select("root_id", "method_key").unionByName(found.select("root_id", "method_key"))


@query("""SELECT 'R:' || r_regionkey AS path, 0 AS depth FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'R:1 -> N:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'R:1 -> N:' || n_nationkey || ' -> S:' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1""")
def q_call_tree(spark, d):
    """SK-9, G-7, S-50: the call tree of one entry, from the edges of its result."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    root, blank = F.lit("root").alias("root_id"), spark.createDataFrame([], "root_id string")
    edges = n.select(root, node("R", "n_regionkey").alias("caller"), node("N", "n_nationkey").alias("callee")).unionByName(s.select(root, node("N", "s_nationkey").alias("caller"), node("S", "s_suppkey").alias("callee")))
    entries = spark.createDataFrame([("root", "R:1")], "root_id string, method_key string")
    return reports.tree(Result(entries, blank, edges, blank, blank), "root").select("path", "depth")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.b.Real' || p_size WHEN 1 THEN CASE WHEN p_size % 3 = 2 THEN 'ENTITY' END WHEN 3 THEN 'Plain' END AS entity FROM part""")
def q_concrete(spark, d):
    """P-26: classes that can be entities; Object, wildcards and type variables in scope, whatever their letter, can't, names like another class's variable can."""
    from ripplegraph.operators.symbols import concrete

    p, k = read(spark, d, "part"), F.col("p_partkey") % 4
    named = F.when(k == 0, cat("a.b.Real", "$p_size")).when(k == 1, "ENTITY").when(k == 2, F.element_at(F.array(F.lit("?"), F.lit("Object")), (F.col("p_size") % 2 + 1).cast("int"))).otherwise("Plain")
    owner = F.element_at(F.array(F.lit("a.Base"), F.lit("a.Base$Inner"), F.lit("a.Other")), (F.col("p_size") % 3 + 1).cast("int"))
    none = []
    classes = [("p", "a.Base", "Base", "class", False, False, ["ID", "ENTITY"], True), ("p", "a.Base$Inner", "Inner", "class", False, False, none, True), ("p", "a.Other", "Other", "class", False, False, ["T"], True), ("p", "a.Third", "Third", "class", False, False, ["Plain"], True)]
    facts = facts_of(spark, {"src_class": spark.createDataFrame(classes, FACTS["src_class"])})
    return concrete(facts, p.select("p_partkey", named.alias("entity"), owner.alias("at")), ["entity"], "at").select("p_partkey", "entity")


@query("SELECT extractor, n FROM (SELECT 'gated' AS extractor, COUNT(*) AS n FROM supplier WHERE s_suppkey % 3 = 0), (SELECT 1) UNION ALL SELECT 'broken 解析失败：', 1")
def q_extractor_gates(spark, d):
    """P-12, G-15, C-7: extractors run over the contexts that they support, and one that fails leaves a warning."""
    s = read(spark, d, "supplier")
    c = Cases(spark, "s_suppkey")
    c.method(s, cat("a.S", "$s_suppkey"), "run", text=(F.col("s_suppkey") % 3).cast("string"))
    context = extractors.contexts(c.facts(), Options())

    def gated(x):
        return x.rows.select("ctx_id", F.lit("REDIS").alias("type"), F.lit("gated").alias("name"), F.lit("READ").alias("operation"), F.lit(0).alias("conf_rank"), F.col("ctx_id").alias("detail"), F.lit("own").alias("rule"))

    def broken(x):
        raise ValueError("no")

    gated.supports = "text = '0'"
    found, warnings = extractors.run([gated, broken], context)
    return found.groupBy(F.col("name").alias("extractor")).agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([(w.removesuffix("no"), 1) for w in warnings], "extractor string, n long"))


@query(r"""SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'a' || p_size || ',b' WHEN 1 THEN 'a' || p_size || ',s.b' WHEN 2 THEN 'a' || p_size WHEN 3 THEN 'a' || p_size || ',b,c' WHEN 4 THEN 'a' || p_size || ',b' WHEN 5 THEN 'a' || p_size || ',b' WHEN 6 THEN 'a' || p_size WHEN 7 THEN 'a' || p_size || ',b' WHEN 8 THEN 'a' || p_size || ',b' WHEN 9 THEN 'a' || p_size WHEN 10 THEN 'a' || p_size ELSE 'a' || p_size || ',b' END AS tables, p_partkey % 12 <> 11 AS parsed FROM part""")
def q_sql_shapes(spark, d):
    """S-35, S-36, X-6: tables of joins, lists, subqueries, WITH, UNION, INSERT SELECT, UPDATE, DELETE, quoted names, comments and literals, and of what can't be parsed."""
    from ripplegraph.sources import mapper

    a = cat("a", "$p_size")
    shapes = [
        ("select x.* from ", " x, b as y where x.id = y.id"),
        ("select * from ", " left join s.b on 1 = 1 where exists (select 1)"),
        ("delete from ", " where id in (1, 2)"),
        ("select * from ", " union all select * from b union select * from c order by 1"),
        ("insert into ", " (x, y) select x, y from b where z > 0"),
        ("update ", " set x = (select max(x) from b) where id = 1"),
        ("with q as (select * from ", " where x = 'from zz') select * from q"),
        ("select * from (select * from ", " t inner join b using (id)) v"),
        ("select * from `", "` t straight_join `b` on t.id = b.id"),
        ("/* from y */ select extract(year from d) from ", " -- join z\n where n = 'it''s'"),
        ("select * from ", " for update"),
        ("oops (( from ", " join b"),
    ]
    sql = F.lit("")
    for i, (x, y) in enumerate(shapes):
        sql = F.when(F.col("p_partkey") % 12 == i, F.concat(F.lit(x), a, F.lit(y))).otherwise(sql)
    read_ = read(spark, d, "part").select("p_partkey", mapper.statement_tables(sql).alias("t"))
    return read_.select("p_partkey", F.array_join(F.array_sort("t.tables"), ",").alias("tables"), F.col("t.parsed").alias("parsed"))


@query(r"""WITH v AS (SELECT n_nationkey + 1 AS line_no, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN '/a b' WHEN 2 THEN '/x/' || n_regionkey WHEN 3 THEN '/y?z=' || n_regionkey ELSE '/' END AS value FROM nation),
e AS (SELECT *, CASE WHEN NOT starts_with(value, '/') THEN '必须以 `/` 开头，请输入接口路径，不要输入完整 URL。' WHEN value = '/' THEN '不能只输入根路径 `/`。' WHEN contains(value, ' ') THEN '路径中不能包含空格或制表符；请确认是否一行写了多个接口。' WHEN contains(value, '?') THEN '请只输入路径，不要包含 query 参数或 fragment。' END AS error FROM v),
g AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY line_no) AS nth FROM e WHERE error IS NULL), d AS (SELECT * FROM g WHERE nth > 1)
SELECT 'good' AS kind, value AS said FROM g WHERE nth = 1 UNION ALL SELECT 'error', '第 ' || line_no || ' 行 `' || value || '`：' || error FROM (SELECT * FROM e WHERE error IS NOT NULL ORDER BY line_no LIMIT 20)
UNION ALL SELECT 'error', '还有 ' || COUNT(*) - 20 || ' 条错误未显示。' FROM e WHERE error IS NOT NULL HAVING COUNT(*) > 20
UNION ALL SELECT 'note', '已自动去重 ' || COUNT(*) || ' 行重复接口，将仅扫描 ' || (SELECT COUNT(*) FROM g WHERE nth = 1) || ' 个唯一接口。' FROM d HAVING COUNT(*) > 0 UNION ALL SELECT 'note', '- 第 ' || line_no || ' 行重复：`' || value || '`' FROM d""")
def q_batch_messages(spark, d):
    """SC-9, S-48, O-5, O-6, P-28: inputs that run, messages about the others, and the note on duplicates."""
    k = F.col("n_nationkey")
    value = F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, "/a b").when(k % 5 == 2, cat(" /x/", "$n_regionkey", "\t")).when(k % 5 == 3, cat("/y?z=", "$n_regionkey")).otherwise("/")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k, value.alias("v")))), lambda x: x["v"])
    checked = materialize(batch.validate(batch.split_lines(read(spark, d, "nation").agg(F.array_join(lines, "\r\n").alias("raw")))), "checked")
    good = checked.filter("error is null and not duplicate").select(F.lit("good").alias("kind"), F.col("value").alias("said"))
    return good.unionByName(batch.messages(checked).select("kind", "said"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND lower(p_name) LIKE '%a%' THEN 'READ' ELSE 'CALL' END AS operation, NOT (p_partkey % 4 = 0 AND (p_size % 10 = 3 OR lower(p_name) LIKE '%a%')) AS stays FROM part""")
def q_query_patterns(spark, d):
    """P-21 to P-23, A-3: external calls told as queries or left out by patterns, substrings in any case or expressions; a broken one matches nothing."""
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "EXTERNAL_HTTP").otherwise("MYSQL").alias("type"), cat("$p_name", "#", "$p_size").alias("name"), F.lit("CALL").alias("operation"))
    told_ = resources.reclassify(rows.withColumn("name", F.col("name")), [r"regex:^[^#]*a", "regex:("])
    kept = resources.drop_matching(rows, ["regex:^[^#]*A", r"regex:#\d?3$"]).select("p_partkey", F.lit(True).alias("stays"))
    return told_.join(kept, "p_partkey", "left").select("p_partkey", "operation", F.coalesce("stays", F.lit(False)).alias("stays"))


@query("""SELECT 'S' || s_suppkey AS method_key, s_suppkey % 4 = 3 AND s_suppkey % 3 <> 0 AS shown FROM supplier""")
def q_shown_methods(spark, d):
    """P-5 to P-8, SC-3: methods that a graph may show: not of excluded packages and, if asked for, only of the project's own source."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    owner = F.when(k % 4 == 0, cat("java.util.S", "$s_suppkey")).when(k % 4 == 1, cat("org.springframework.S", "$s_suppkey")).when(k % 4 == 2, cat("own.gen.S", "$s_suppkey")).otherwise(cat("own.S", "$s_suppkey"))
    method = fact(s, "method", method_key=cat("S", "$s_suppkey"), class_fqn=owner, name="m", param_types=[], modifiers=[], stmts=[], is_project_source=k % 3 != 0)
    made = Engine(facts_of(spark, {"method": method}), Options(excluded_prefixes=(*Options().excluded_prefixes, "own.gen."), only_project_source=True))
    return made.methods.select("method_key", "shown")

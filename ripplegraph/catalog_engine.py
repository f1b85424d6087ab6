"""More queries: file readers, statement parsing, placeholders, and the whole engine over facts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.catalog import node, query, statements
from ripplegraph.functions import text
from ripplegraph.model import Options
from ripplegraph.operators import reports
from ripplegraph.operators.symbols import formatted
from ripplegraph.plans.engine import Engine, facts_of
from ripplegraph.sources import batch, config, mapper
from ripplegraph.storage import read

s = lambda c: F.col(c).cast("string")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ods.' || lower(replace(p_type, ' ', '_')) || ',t' || p_size WHEN 1 THEN lower(replace(p_name, ' ', '_')) WHEN 2 THEN 'log' || p_size || ',t' || p_size ELSE 't' || p_size END AS tables FROM part""")
def q_sql_tables(spark, d):
    """S-35, X-6: tables of parsed statements; names of WITH queries aren't tables."""
    t = mapper.statement_tables(text.clean_statement(F.col("sql")))
    return statements(spark, d).select("p_partkey", F.array_join(F.array_sort(t["tables"]), ",").alias("tables"))


@query("""SELECT p_partkey, 'part_' || p_size AS table_name, CASE WHEN p_partkey % 2 = 0 THEN 'READ' ELSE 'WRITE' END AS operation FROM part""")
def q_mapper_xml(spark, d):
    """SC-4, J-11, J-12, G-6: mapper files, includes put in, one statement a part."""
    open_, close = F.when(F.col("p_partkey") % 2 == 0, "select").otherwise("delete"), F.when(F.col("p_partkey") % 2 == 0, "* ").otherwise("")
    xml = F.concat(F.lit("<mapper namespace='m.P"), s("p_partkey"), F.lit("'><sql id='t'>part_"), s("p_size"), F.lit("</sql><"), open_, F.lit(" id='q'>"), open_, F.lit(" "), close, F.lit("from <include refid='t'/> <where>id = #{id}</where></"), open_, F.lit("></mapper>"))
    files = read(spark, d, "part").select(F.lit("p").alias("project"), node("P", "p_partkey").alias("path"), xml.alias("text"))
    found = mapper.statements(files).withColumn("t", mapper.statement_tables(text.clean_statement(F.col("sql"))))
    key = F.regexp_extract("namespace", r"(\d+)$", 1).cast("long")
    return found.select(key.alias("p_partkey"), F.explode("t.tables").alias("table_name"), text.statement_operation(F.col("sql")).alias("operation"))


def config_files(spark, d):
    """One properties file a region, and one YAML file that overwrites some of it."""
    n = read(spark, d, "nation")
    line = F.concat(F.lit("nation.k"), s("n_nationkey"), F.lit(" = "), F.col("n_name"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("l")))), lambda x: x["l"]), "\n")
    plain = n.groupBy("n_regionkey").agg(joined(line).alias("text")).select(node("R", "n_regionkey").alias("project"), F.lit(0).alias("ext_rank"), F.lit("a.properties").alias("path"), "text")
    nested = F.concat(F.lit("  k"), s("n_nationkey"), F.lit(": '"), F.col("n_name"), F.lit("-y' # note"))
    over = n.filter("n_nationkey % 3 = 0").groupBy("n_regionkey").agg(joined(nested).alias("text"))
    over = over.select(node("R", "n_regionkey").alias("project"), F.lit(1).alias("ext_rank"), F.lit("b.yml").alias("path"), F.concat(F.lit("nation:\n"), "text").alias("text"))
    return plain.unionByName(over)


@query("SELECT 'R:' || n_regionkey AS project, 'nation.k' || n_nationkey AS key, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '-y' ELSE '' END AS value FROM nation")
def q_config_files(spark, d):
    """SC-5 to SC-8, A-21, O-1: properties and YAML, the later writer kept."""
    return config.key_values(config_files(spark, d))


@query("""SELECT c_custkey, CASE WHEN n.n_nationkey IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'at none' ELSE 'at ${nation.k99}' END
ELSE 'at ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '-y' ELSE '' END END AS resolved
FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey AND c_custkey % 5 <> 0""")
def q_placeholders(spark, d):
    """G-5, S-16: placeholders with and without default, from the files of the row's own project."""
    n = read(spark, d, "nation")
    c = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.when(F.col("c_custkey") % 5 == 0, "99").otherwise(s("n_nationkey"))
    default = F.when(F.col("c_custkey") % 2 == 0, ":none").otherwise("")
    rows = c.select("c_custkey", node("R", "n_regionkey").alias("project"), F.concat(F.lit("at ${nation.k"), key, default, F.lit("}")).alias("raw"))
    return config.resolve(rows, config.key_values(config_files(spark, d)), "raw", "resolved").select("c_custkey", "resolved")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'http://' || s_name || '/100%/' || s_nationkey END AS url FROM supplier")
def q_url_format(spark, d):
    """S-13, S-14: addresses from templates; a missing argument leaves none."""
    args = F.when(F.col("s_suppkey") % 3 > 0, F.array(F.col("s_name"), s("s_nationkey"))).otherwise(F.array("s_name"))
    return read(spark, d, "supplier").select("s_suppkey", formatted(F.lit("http://%s/100%%/%s"), args).alias("url"))


@query("""WITH RECURSIVE h(n_nationkey, rest, v) AS (SELECT n_nationkey, n_name, 0::BIGINT FROM nation UNION ALL SELECT n_nationkey, substr(rest, 2), (v * 31 + unicode(rest[1])) % 4294967296 FROM h WHERE rest <> '')
SELECT n_nationkey, 'n' || lower(to_hex(v)) AS id FROM h WHERE rest = ''""")
def q_node_id(spark, d):
    """S-39: ids of diagram nodes."""
    return read(spark, d, "nation").select("n_nationkey", text.node_id(F.col("n_name")).alias("id"))


@query(r"""WITH v AS (SELECT page_id AS line_no, trim(regexp_replace(url, '^[a-z]+://[^/]*', '')) AS value FROM pages),
e AS (SELECT *, CASE WHEN NOT starts_with(value, '/') THEN 'no_leading_slash' WHEN value = '/' THEN 'root_only' WHEN regexp_matches(value, '\s') THEN 'white_space' WHEN contains(value, '://') THEN 'scheme_or_host' WHEN regexp_matches(value, '[?#]') THEN 'query_or_fragment' END AS error FROM v WHERE value <> '')
SELECT line_no, value, error, error IS NULL AND row_number() OVER (PARTITION BY value ORDER BY line_no) > 1 AS duplicate FROM e""")
def q_batch_inputs(spark, d):
    """SC-9, P-28, A-19: inputs with their first error, or told as duplicates."""
    value = F.trim(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    rows = read(spark, d, "pages").select(F.col("page_id").alias("line_no"), value.alias("value")).filter("value <> ''")
    return batch.validate(rows)


def shop_facts(spark, d):
    """Facts from region (controllers), nation (services) and supplier (cache users)."""
    r, n, p = read(spark, d, "region"), read(spark, d, "nation"), read(spark, d, "supplier")
    none = lambda t: F.lit(None).cast(t)
    empty = F.array().cast("array<string>")

    def method(df, letter, key, name):
        k = node(letter, key)
        return df.select(F.lit("p").alias("project"), F.concat(k, F.lit("#run")).alias("method_key"), F.concat(F.lit("a."), F.replace(k, F.lit(":"), F.lit("_"))).alias("class_fqn"), F.lit("run").alias("name"), empty.alias("param_types"), F.lit("void").alias("return_type"),
                         F.array(F.lit("public")).alias("modifiers"), F.col(name).alias("text"), F.array(F.lit("x")).alias("stmts"), F.lit(True).alias("is_project_source"), F.lit(0).alias("ord"))

    client = spark.createDataFrame([("p", "redis#get", "x.RedisTemplate", "get", [], "void", ["public"], "", None, False, 0)], "project string, method_key string, class_fqn string, name string, param_types array<string>, return_type string, modifiers array<string>, text string, stmts array<string>, is_project_source boolean, ord int")
    methods = method(r, "R", "r_regionkey", "r_name").unionByName(method(n, "N", "n_nationkey", "n_name")).unionByName(method(p, "S", "s_suppkey", "s_name")).unionByName(client)

    def call(df, caller, callee):
        key = lambda x: F.concat(node(*x), F.lit("#run")) if isinstance(x, tuple) else F.lit(x)
        return df.select(F.lit("p").alias("project"), F.concat_ws(">", key(caller), key(callee)).alias("call_id"), key(caller).alias("caller_key"), F.lit(0).alias("ord"), F.lit("call").alias("kind"), key(callee).alias("callee_key"), none("string").alias("ref_name"),
                         F.lit("call()").alias("text"), none("string").alias("qualifier_type"), empty.alias("qualifier_type_args"), none("string").alias("qualifier_symbol"))

    calls = call(n, ("R", "n_regionkey"), ("N", "n_nationkey")).unionByName(call(p, ("N", "s_nationkey"), ("S", "s_suppkey"))).unionByName(call(p, ("S", "s_suppkey"), "redis#get"))
    cid = F.concat(node("S", "s_suppkey"), F.lit("#run>redis#get"))
    attrs = F.create_map(F.lit("value"), F.array(F.concat(F.lit("/r/"), s("r_regionkey"))))
    notes = r.select(F.lit("p").alias("project"), F.lit("method").alias("target_kind"), F.concat(node("R", "r_regionkey"), F.lit("#run")).alias("target_id"), F.lit(0).alias("ord"), F.lit("w.GetMapping").alias("fqn"), F.lit("GetMapping").alias("short_name"), attrs.alias("attrs"), attrs.alias("declared_attrs"), none("map<string,string>").alias("attr_text"))
    given = {
        "method": methods,
        "src_class": methods.select("project", "class_fqn", F.element_at(F.split("class_fqn", r"\."), -1).alias("short_name"), F.lit("class").alias("kind"), F.lit(False).alias("is_abstract"), F.lit(False).alias("is_final"), empty.alias("type_params"), "is_project_source"),
        "call_site": calls,
        "call_arg": p.select(cid.alias("call_id"), F.lit(0).alias("pos"), node("S", "s_suppkey").alias("expr_id"), F.lit("java.lang.String").alias("type_fqn"), empty.alias("type_args")),
        "expr": p.select(node("S", "s_suppkey").alias("expr_id"), F.lit("literal").alias("kind"), F.col("s_name").alias("text"), F.col("s_name").alias("const_value"), none("string").alias("ref_symbol"), empty.alias("operands")),
        "annotation": notes,
    }
    return facts_of(spark, given)


@query("""WITH m AS (SELECT r_regionkey, 2 + COUNT(DISTINCT n_nationkey) + COUNT(DISTINCT s_suppkey) AS methods FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(r_regionkey + 1 AS INT) AS idx, 'SUCCESS' AS status, s_name AS name, '只读' AS operation, '推断' AS confidence, methods
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN m USING (r_regionkey)
UNION ALL SELECT 100, 'SKIPPED', NULL, NULL, NULL, 0""")
def q_engine_batch(spark, d):
    """The whole engine: paths to controllers, the walk, extraction, merging, and the rows of a batch report."""
    engine = Engine(shop_facts(spark, d), Options())
    asked = read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("idx"), F.concat(F.lit("/r/"), s("r_regionkey")).alias("value"))
    rows, result = engine.batch(asked.unionByName(spark.createDataFrame([(100, "/none")], "idx int, value string")))
    told = reports.labelled(result.resources).select(F.col("root_id").alias("input"), "name", F.col("operation_label").alias("operation"), F.col("confidence_label").alias("confidence"))
    return reports.batch_rows(rows, result).join(told, "input", "left").select("idx", "status", "name", "operation", "confidence", "methods")

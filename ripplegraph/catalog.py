"""Queries over the data folder that run each operator on analog graphs, paths and texts, and their SQL twins.

The analog call graph: region -> nation -> supplier and customer, customer -> order -> part. Confidence comes
from the return flag, operation from the line status; users who follow each other in the event stream
make a cyclic graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ripplegraph.functions import text
from ripplegraph.operators import joins, resources
from ripplegraph.plans.reach import closure, reach, unfold
from ripplegraph.storage import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- analog facts ----------------------------------------------------------------------------------


def node(letter: str, key: str):
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def tree_edges(spark: SparkSession, d: str, orders: bool = True) -> DataFrame:
    """region -> nation -> supplier and customer [-> order]."""
    n, s, c = (read(spark, d, t) for t in ("nation", "supplier", "customer"))
    found = [
        n.select(node("R", "n_regionkey").alias("src"), node("N", "n_nationkey").alias("dst")),
        s.select(node("N", "s_nationkey"), node("S", "s_suppkey")),
        c.select(node("N", "c_nationkey"), node("C", "c_custkey")),
    ]
    if orders:
        found.append(read(spark, d, "orders").select(node("C", "o_custkey"), node("O", "o_orderkey")))
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out.withColumn("conf", F.lit(0))


def flag_rank():
    return F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    """The tree, and order -> part once for each line item; a walk takes the most certain of equal edges."""
    items = read(spark, d, "lineitem").select(node("O", "l_orderkey").alias("src"), node("P", "l_partkey").alias("dst"), flag_rank().alias("conf"))
    return tree_edges(spark, d).unionByName(items)


TREE = """
  SELECT 'R:'||n_regionkey AS src, 'N:'||n_nationkey AS dst, 0 AS conf FROM nation
  UNION ALL SELECT 'N:'||s_nationkey, 'S:'||s_suppkey, 0 FROM supplier
  UNION ALL SELECT 'N:'||c_nationkey, 'C:'||c_custkey, 0 FROM customer
  UNION ALL SELECT 'C:'||o_custkey, 'O:'||o_orderkey, 0 FROM orders"""
ITEMS = """
  UNION ALL SELECT 'O:'||l_orderkey, 'P:'||l_partkey, MIN(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)
  FROM lineitem GROUP BY 1, 2"""
SHORT = """
  SELECT 'R:'||n_regionkey AS src, 'N:'||n_nationkey AS dst FROM nation
  UNION ALL SELECT 'N:'||s_nationkey, 'S:'||s_suppkey FROM supplier
  UNION ALL SELECT 'N:'||c_nationkey, 'C:'||c_custkey FROM customer"""
NEXT_USER = "SELECT DISTINCT user_id AS src, nxt AS dst FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL"


def resource_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as resources: part name, operation, confidence, and the order as evidence."""
    return read(spark, d, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "WRITE").otherwise("READ").alias("operation"),
        F.lit("MYSQL").alias("type"),
        node("P", "l_partkey").alias("name"),
        flag_rank().alias("conf_rank"),
        node("O", "l_orderkey").alias("detail"),
        node("O", "l_orderkey").alias("ord"),
    )


RESOURCE = """SELECT CASE WHEN l_linestatus = 'F' THEN 'WRITE' ELSE 'READ' END AS operation, 'MYSQL' AS type, 'P:'||l_partkey AS name,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS conf_rank, 'O:'||l_orderkey AS detail FROM lineitem"""

# ---- reachability ----------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE e AS ({TREE}{ITEMS}), r(root, node, depth, conf) AS (
  SELECT 'R:'||r_regionkey, 'R:'||r_regionkey, 0, 0 FROM region
  UNION SELECT r.root, e.dst, r.depth + 1, greatest(r.conf, e.conf) FROM r JOIN e ON r.node = e.src)
SELECT root, node, MIN(depth) AS depth, MIN(conf) AS conf FROM r GROUP BY root, node""")
def q_reach_region(spark, d):
    """G-1, G-13: all nodes of every region with depth and confidence of the best path."""
    roots = read(spark, d, "region").select(node("R", "r_regionkey").alias("root"), node("R", "r_regionkey").alias("node"))
    return reach(all_edges(spark, d), roots)


@query(f"""WITH RECURSIVE e AS ({TREE}), r(root, node) AS (
  SELECT 'N:'||n_nationkey, 'N:'||n_nationkey FROM nation UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src)
SELECT root, COUNT(*) AS reached FROM r GROUP BY root""")
def q_reach_multi_root(spark, d):
    """G-1, U-1: one walk for all nations, counted by root."""
    roots = read(spark, d, "nation").select(node("N", "n_nationkey").alias("root"), node("N", "n_nationkey").alias("node"))
    return reach(tree_edges(spark, d), roots).groupBy("root").agg(F.count("*").alias("reached"))


@query(f"""WITH RECURSIVE e AS ({TREE}{ITEMS}), r(root, node, depth) AS (
  SELECT 'R:'||r_regionkey, 'R:'||r_regionkey, 0 FROM region
  UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 3)
SELECT root, node, MIN(depth) AS depth FROM r GROUP BY root, node""")
def q_reach_depth_limited(spark, d):
    """G-1: the depth limit."""
    roots = read(spark, d, "region").select(node("R", "r_regionkey").alias("root"), node("R", "r_regionkey").alias("node"))
    return reach(all_edges(spark, d), roots, max_depth=3).drop("conf")


@query(f"""WITH RECURSIVE e AS ({NEXT_USER}), r(node) AS (SELECT MIN(user_id) FROM events UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT node FROM r""")
def q_reach_cyclic(spark, d):
    """G-1: cycles end at visited nodes."""
    events = read(spark, d, "events")
    nxt = F.lead("user_id").over(W.partitionBy("event_type").orderBy("event_id"))
    edges = events.select(F.col("user_id").alias("src"), nxt.alias("dst")).filter("dst is not null").withColumn("conf", F.lit(0))
    roots = events.agg(F.min("user_id").alias("root")).select("root", F.col("root").alias("node"))
    return reach(edges, roots, max_depth=1000).select("node")


@query(f"""WITH RECURSIVE e AS ({TREE}{ITEMS}), r(node, path, hops) AS (
  SELECT 'R:'||r_regionkey, ['R:'||r_regionkey], 1 FROM region
  UNION ALL SELECT e.dst, list_append(r.path, e.dst), r.hops + 1 FROM r JOIN e ON r.node = e.src AND e.dst NOT LIKE 'P:%')
SELECT node, CASE WHEN hops > 3 THEN path[1] || ' -> ... -> ' || array_to_string(path[-2:], ' -> ') ELSE array_to_string(path, ' -> ') END AS evidence FROM r""")
def q_path_evidence(spark, d):
    """G-11, G-12: paths kept on the way, long ones abbreviated."""
    roots = read(spark, d, "region").select(node("R", "r_regionkey").alias("root"), node("R", "r_regionkey").alias("node"))
    found = reach(tree_edges(spark, d), roots, with_path=True)
    return found.select("node", text.display_path(F.col("path"), 1, 2, 3).alias("evidence"))


@query(f"""WITH RECURSIVE e AS ({TREE}{ITEMS}), r(root, node, conf) AS (
  SELECT 'C:'||c_custkey, 'C:'||c_custkey, 0 FROM customer UNION SELECT r.root, e.dst, greatest(r.conf, e.conf) FROM r JOIN e ON r.node = e.src)
SELECT root, CASE c WHEN 0 THEN '已确认' WHEN 1 THEN '推断' ELSE '待确认' END AS confidence, COUNT(*) AS nodes
FROM (SELECT root, node, MIN(conf) AS c FROM r GROUP BY root, node) GROUP BY 1, 2""")
def q_path_confidence(spark, d):
    """G-13, S-43: the least certain edge of a path decides, with labels."""
    from ripplegraph.model import CONFIDENCE

    roots = read(spark, d, "customer").select(node("C", "c_custkey").alias("root"), node("C", "c_custkey").alias("node"))
    label = F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE.values()]), F.col("conf") + 1)
    return reach(all_edges(spark, d), roots).groupBy("root", label.alias("confidence")).agg(F.count("*").alias("nodes"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({SHORT})), t(node, path, depth, repeated) AS (
  SELECT 'R:0', ['R:0'], 0, false UNION ALL
  SELECT e.dst, list_append(t.path, e.dst), t.depth + 1, list_contains(t.path, e.dst) FROM t JOIN e ON t.node = e.src WHERE NOT t.repeated AND t.depth < 5)
SELECT array_to_string(path, ' -> ') AS path, node, depth, repeated FROM t""")
def q_tree_unfold(spark, d):
    """G-7: the call tree with a cycle guard on each path."""
    return unfold(tree_edges(spark, d, orders=False), "R:0", 5)


@query(f"""WITH RECURSIVE e AS ({SHORT}), c(sub, ancestor, depth) AS (
  SELECT dst, src, 1 FROM e UNION SELECT c.sub, e.src, c.depth + 1 FROM c JOIN e ON c.ancestor = e.dst)
SELECT sub, ancestor, MIN(depth) AS depth FROM c GROUP BY 1, 2""")
def q_hierarchy_closure(spark, d):
    """G-8, SC-14: transitive ancestors."""
    return closure(tree_edges(spark, d, orders=False).select(F.col("dst").alias("sub"), F.col("src").alias("super")))


# ---- joins -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def q_call_resolve_inner(spark, d):
    """J-1: calls whose target is known."""
    return joins.resolve(read(spark, d, "orders"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")[0].select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, 'unresolved call: ' || o_orderkey AS warning FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_call_unresolved(spark, d):
    """J-1: one warning for each call without a target."""
    missing = joins.resolve(read(spark, d, "orders"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")[1]
    return missing.select("o_orderkey", F.concat(F.lit("unresolved call: "), F.col("o_orderkey").cast("string")).alias("warning"))


@query("""WITH c AS (SELECT n_nationkey, s_suppkey, s_name LIKE '%7' AS named, s_acctbal > 8000 AS prim FROM nation JOIN supplier ON s_nationkey = n_nationkey),
f AS (SELECT *, COUNT(*) OVER w AS n, bool_or(named) OVER w AS any_named, SUM(prim::INT) OVER w AS prims FROM c WINDOW w AS (PARTITION BY n_nationkey))
SELECT n_nationkey, s_suppkey FROM f WHERE CASE WHEN n = 1 THEN true WHEN any_named THEN named WHEN prims = 1 THEN prim ELSE true END""")
def q_dispatch_narrow(spark, d):
    """J-3 to J-5: candidates narrowed by name, then by the only primary one."""
    c = read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joins.narrow(c, ["n_nationkey"], F.col("s_name").like("%7"), F.col("s_acctbal") > 8000).select("n_nationkey", "s_suppkey")


PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


def page_paths(spark, d):
    """page_id and the path of its address."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return read(spark, d, "pages").select("page_id", "url", bare.alias("path"))


@query(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), e AS (SELECT path, COUNT(*) AS n FROM p WHERE page_id % 2 = 0 GROUP BY path)
SELECT page_id, CASE WHEN path = '' THEN 'SKIPPED' WHEN COALESCE(n, 0) = 1 THEN 'SUCCESS' ELSE 'SKIPPED' END AS status,
CASE WHEN path = '' THEN 'not a path' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' END AS reason FROM p LEFT JOIN e USING (path)""")
def q_batch_classify(spark, d):
    """P-32: each input's status and the first reason against it."""
    p = page_paths(spark, d)
    counted = joins.cardinality(p, p.filter("page_id % 2 = 0"), ["path"])
    status = joins.status_of(F.col("matches"))
    reason = F.when(F.col("path") == "", "not a path").otherwise(F.when(status != "ok", status))
    return counted.select("page_id", F.when(reason.isNull(), "SUCCESS").otherwise("SKIPPED").alias("status"), reason.alias("reason"))


@query(r"""WITH v AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+://[^/]*', '') END AS value FROM pages)
SELECT page_id, CASE WHEN NOT starts_with(value, '/') THEN 'no_leading_slash' WHEN value = '/' THEN 'root_only' WHEN regexp_matches(value, '\s') THEN 'white_space'
WHEN contains(value, '://') THEN 'scheme_or_host' WHEN regexp_matches(value, '[?#]') THEN 'query_or_fragment' END AS error FROM v""")
def q_validate_paths(spark, d):
    """P-27, P-28: the first rule that an input breaks."""
    value = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return read(spark, d, "pages").select("page_id", text.path_error(value).alias("error"))


@query(f"""SELECT page_id, '/' || regexp_replace('api/' || regexp_replace(trim({PATH}), '^/+|/+$', '', 'g'), '/+', '/', 'g') AS path FROM pages""")
def q_normalize_path(spark, d):
    """S-1: a class part and a method part as one path."""
    p = page_paths(spark, d)
    return p.select("page_id", text.normalize_path(F.lit("/api/"), F.col("path")).alias("path"))


TOPICS = """produced AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN '${mq.' || event_type || '.topic}' WHEN user_id % 3 = 1 THEN 'a.b.' || event_type ELSE event_type || ':tag' END AS p FROM events),
consumed AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN '${mq.' || event_type || '.topic}' ELSE 'x.' || event_type END AS c FROM events)"""


@query(f"""WITH {TOPICS}, k AS (SELECT p, c, split_part(p, ':', 1) AS pt, split_part(c, ':', 1) AS ct FROM produced, consumed)
SELECT p, c FROM k WHERE CASE WHEN starts_with(pt, '${{') OR starts_with(ct, '${{') THEN p = c OR pt = ct ELSE p = c OR pt = ct OR regexp_extract(pt, '[^.]*$') = regexp_extract(ct, '[^.]*$') END""")
def q_topic_match(spark, d):
    """J-6, P-3, P-4, S-30: equal meaning as one equality; the twin keeps the OR."""
    produced, consumed = topics(spark, d)
    return joins.match_topics(produced, consumed, "p", "c").select("p", "c")


def topics(spark, d):
    e = read(spark, d, "events")
    placeholder = F.concat(F.lit("${mq."), "event_type", F.lit(".topic}"))
    kind = F.col("user_id") % 3
    p = F.when(kind == 0, placeholder).when(kind == 1, F.concat(F.lit("a.b."), "event_type")).otherwise(F.concat("event_type", F.lit(":tag")))
    c = F.when(F.col("user_id") % 2 == 0, placeholder).otherwise(F.concat(F.lit("x."), "event_type"))
    return e.select(p.alias("p")).distinct(), e.select(c.alias("c")).distinct()


@query("""WITH m AS (SELECT n_name AS name, 'project-' || n_regionkey AS target FROM nation WHERE n_nationkey % 2 = 0),
s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '${' || n_name || '}' WHEN 1 THEN n_name || '/v1' ELSE n_name END AS service FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, trim(split_part(service, '/', 1)) AS key FROM s)
SELECT c_custkey, service, COALESCE(a.target, b.target, c.target, e.target) AS target FROM k LEFT JOIN m a ON a.name = service LEFT JOIN m b ON b.name = key
LEFT JOIN m c ON c.name = regexp_replace(service, '^\\$\\{(.*)\\}$', '\\1') LEFT JOIN m e ON e.name = regexp_replace(key, '^\\$\\{(.*)\\}$', '\\1')""".replace("\\\\", "\\"))
def q_service_mapping(spark, d):
    """J-8, S-46: the first form of a service name that is mapped."""
    n = read(spark, d, "nation")
    mapping = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("project-"), F.col("n_regionkey").cast("string")).alias("target"))
    kind = F.col("c_custkey") % 3
    service = F.when(kind == 0, F.concat(F.lit("${"), "n_name", F.lit("}"))).when(kind == 1, F.concat("n_name", F.lit("/v1"))).otherwise(F.col("n_name"))
    s = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", service.alias("service"))
    s = s.withColumn("key", F.trim(F.substring_index("service", "/", 1)))
    return joins.first_mapping(s, mapping, "service", "key").drop("key")


@query("""WITH p AS (SELECT n_name AS name, '/base/' || n_nationkey AS base_path FROM nation), w AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '/base/' || (c_nationkey + 3) END AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, value, (SELECT MIN(name) FROM p WHERE p.name = value OR p.base_path = value) AS project FROM w""")
def q_project_lookup(spark, d):
    """J-9: a project by its name or its folder."""
    n = read(spark, d, "nation")
    projects = n.select(F.col("n_name").alias("name"), F.concat(F.lit("/base/"), F.col("n_nationkey").cast("string")).alias("base_path"))
    other = F.concat(F.lit("/base/"), (F.col("c_nationkey") + 3).cast("string"))
    wanted = read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = wanted.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(other).alias("value"))
    return joins.lookup_project(wanted, projects, "value")


# ---- predicates and scalars ------------------------------------------------------------------------

SNAKE = "lower(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


@query(f"""WITH c AS (SELECT p_partkey, p_brand, replace(p_type, ' ', '') || CASE WHEN p_partkey % 4 = 0 THEN 'Example' ELSE '' END AS cls, CASE WHEN p_partkey % 3 = 0 THEN 't_' || p_size WHEN p_partkey % 3 = 1 THEN ' ' END AS given FROM part)
SELECT p_partkey, CASE WHEN trim(given) <> '' THEN given ELSE {SNAKE.format("regexp_replace(cls, 'Example$', '')")} END AS table_name, COALESCE(trim(given) <> '', false) AS explicit FROM c""")
def q_entity_table_name(spark, d):
    """S-2, J-13: the annotated name, else the class name in snake case."""
    p = read(spark, d, "part")
    cls = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.when(F.col("p_partkey") % 4 == 0, "Example").otherwise(""))
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("t_"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, " ")
    out = text.entity_table(given, F.lit(None).cast("string"), F.lit(None).cast("string"), cls)
    return p.select("p_partkey", out.alias("o")).select("p_partkey", F.col("o.name").alias("table_name"), F.col("o.explicit").alias("explicit"))


@query(f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'TMapper' ELSE replace(p_name, ' ', '') || 'Mapper' END AS cls FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(cls, 'Mapper$', ''), 'Example$', '') AS base FROM c)
SELECT p_partkey, CASE WHEN base NOT IN ('T','E','K','V','Object','Any','?','') THEN {SNAKE.format("base")} END AS table_name FROM b""")
def q_table_from_class(spark, d):
    """S-3: a mapper's name as a table's; type variables are none."""
    cls = F.when(F.col("p_partkey") % 10 == 0, "TMapper").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("Mapper")))
    return read(spark, d, "part").select("p_partkey", text.table_from_class(cls).alias("table_name"))


@query("SELECT p_partkey, p_type FROM part WHERE NOT (p_type LIKE 'ECONOMY%' OR p_type LIKE 'PROMO%' OR p_type LIKE 'STANDARD%') AND p_size > 10")
def q_prefix_filter(spark, d):
    """P-5 to P-7: excluded prefixes, and only the project's own."""
    p = read(spark, d, "part")
    return p.filter(~text.starts_with_any(F.col("p_type"), ["ECONOMY", "PROMO", "STANDARD"]) & (F.col("p_size") > 10)).select("p_partkey", "p_type")


NAME = "CASE event_id % 9 WHEN 0 THEN 'getFor' WHEN 1 THEN 'postIt' WHEN 2 THEN 'PutAll' WHEN 3 THEN 'deleteOne' WHEN 4 THEN 'selectOne' WHEN 5 THEN 'countAll' WHEN 6 THEN 'saveAll' WHEN 7 THEN 'removeIt' ELSE event_type END"


def call_names(spark, d):
    names = ["getFor", "postIt", "PutAll", "deleteOne", "selectOne", "countAll", "saveAll", "removeIt"]
    pick = F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 9 + 1).cast("int")), F.col("event_type"))
    return read(spark, d, "events").select("event_id", pick.alias("name"))


@query(f"""WITH c AS (SELECT event_id, {NAME} AS name FROM events) SELECT event_id, CASE WHEN lower(name) LIKE 'get%' THEN 'GET' WHEN lower(name) LIKE 'post%' THEN 'POST'
WHEN lower(name) LIKE 'put%' THEN 'PUT' WHEN lower(name) LIKE 'delete%' THEN 'DELETE' WHEN lower(name) LIKE 'patch%' THEN 'PATCH' ELSE '未声明' END AS verb FROM c""")
def q_http_verb(spark, d):
    """S-11: the verb that a client method's name begins with."""
    return call_names(spark, d).select("event_id", text.http_verb(F.col("name")).alias("verb"))


@query(f"""WITH c AS (SELECT event_id, {NAME} AS name FROM events) SELECT event_id,
CASE WHEN regexp_matches(name, '^(get|has|opsFor)') THEN 'READ' ELSE 'WRITE' END AS redis, CASE WHEN regexp_matches(name, '^(select|count|exists)') THEN 'READ' ELSE 'WRITE' END AS generic,
CASE WHEN regexp_matches(name, '^(select|get|list|page|count)') THEN 'READ' WHEN regexp_matches(name, '^(insert|update|delete|remove|save)') THEN 'WRITE' END AS orm,
CASE WHEN regexp_matches(name, '^(save|delete|remove)') THEN 'WRITE' ELSE 'READ' END AS repository FROM c""")
def q_op_by_prefix(spark, d):
    """S-17 to S-20: reads and writes by method name."""
    n = F.col("name")
    return call_names(spark, d).select(
        "event_id",
        text.redis_operation(n).alias("redis"),
        text.generic_mapper_operation(n).alias("generic"),
        text.orm_operation(n).alias("orm"),
        text.repository_operation(n).alias("repository"),
    )


@query("""SELECT page_id, CASE WHEN lower(url) LIKE '%/en/%' OR regexp_matches(url, '(?i)page=\\d+') THEN 'READ' ELSE 'CALL' END AS operation FROM pages""".replace("\\\\", "\\"))
def q_pattern_reclassify(spark, d):
    """P-21, P-22: external calls that a rule names become reads; a broken expression names none."""
    r = read(spark, d, "pages").select("page_id", F.lit("EXTERNAL_HTTP").alias("type"), F.col("url").alias("name"), F.lit("CALL").alias("operation"))
    return resources.reclassify(r, ["/EN/", r"regex:page=\d+", "regex:("]).select("page_id", "operation")


STATEMENT = "CASE p_partkey % 4 WHEN 0 THEN 'SELECT * FROM t' || p_size || ' a JOIN ods.' || lower(replace(p_type, ' ', '_')) || ' b ON a.id = #{id}' WHEN 1 THEN '  update ' || lower(replace(p_name, ' ', '_')) || ' <set>x = ${v}</set>' WHEN 2 THEN 'insert into log' || p_size || ' select * from t' || p_size ELSE 'with q as (select 1) select * from q, t' || p_size END"


def statements(spark, d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    low = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("_")))
    sql = (
        F.when(kind == 0, F.concat(F.lit("SELECT * FROM t"), size, F.lit(" a JOIN ods."), low("p_type"), F.lit(" b ON a.id = #{id}")))
        .when(kind == 1, F.concat(F.lit("  update "), low("p_name"), F.lit(" <set>x = ${v}</set>")))
        .when(kind == 2, F.concat(F.lit("insert into log"), size, F.lit(" select * from t"), size))
        .otherwise(F.concat(F.lit("with q as (select 1) select * from q, t"), size))
    )
    return read(spark, d, "part").select("p_partkey", sql.alias("sql"))


@query(f"""WITH s AS (SELECT p_partkey, {STATEMENT} AS sql FROM part) SELECT p_partkey, regexp_replace(regexp_replace(sql, '<[^>]+>', ' ', 'g'), '[#$]\\{{[^}}]+\\}}', 'NULL', 'g') AS cleaned,
contains(sql, '${{') AS is_dynamic, CASE WHEN starts_with(lower(ltrim(sql)), 'select') OR starts_with(lower(ltrim(sql)), 'with') THEN 'READ' ELSE 'WRITE' END AS operation FROM s""")
def q_sql_cleanup(spark, d):
    """S-21, S-22: statements without tags and parameters."""
    s = F.col("sql")
    return statements(spark, d).select("p_partkey", text.clean_statement(s).alias("cleaned"), text.is_dynamic(s).alias("is_dynamic"), text.statement_operation(s).alias("operation"))


@query(f"""WITH s AS (SELECT p_partkey, {STATEMENT} AS sql FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(sql, '(?i)\\b(?:from|join|into|update)\\s+([a-zA-Z_][\\w.]*)', 1))), ',') AS tables FROM s""")
def q_sql_fallback(spark, d):
    """S-36: tables by keyword."""
    return statements(spark, d).select("p_partkey", F.array_join(F.array_sort(text.tables_by_keyword(F.col("sql"))), ",").alias("tables"))


# ---- aggregation -----------------------------------------------------------------------------------


@query("SELECT 'O:'||l_orderkey AS caller, 'P:'||l_partkey AS callee, 'call' AS reason, MIN(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2")
def q_edge_distinct(spark, d):
    """A-1: one edge for each caller, callee and reason."""
    e = read(spark, d, "lineitem").select(node("O", "l_orderkey").alias("caller"), node("P", "l_partkey").alias("callee"), F.lit("call").alias("reason"), F.col("l_linenumber").alias("ord"))
    return resources.distinct_edges(e)


@query(f"SELECT DISTINCT type, name, operation, conf_rank, detail FROM ({RESOURCE})")
def q_evidence_distinct(spark, d):
    """A-3: evidence once."""
    return resources.distinct_evidence(resource_rows(spark, d)).drop("ord")


@query("""WITH a AS (SELECT 'P:'||l_partkey AS node, 1 AS ord, l_shipmode_ AS v FROM (SELECT l_partkey, MAX(l_orderkey) AS l_shipmode_ FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)),
b AS (SELECT 'P:'||l_partkey AS node, 2 AS ord, v FROM (SELECT l_partkey, MIN(l_orderkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1))
SELECT node, arg_max(v, ord) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY node""")
def q_merge_results(spark, d):
    """A-8, U-3: two results as one, the later value of a node kept."""
    li = read(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'A'").groupBy(node("P", "l_partkey").alias("node")).agg(F.max("l_orderkey").alias("v")).withColumn("ord", F.lit(1))
    b = li.filter("l_returnflag = 'R'").groupBy(node("P", "l_partkey").alias("node")).agg(F.min("l_orderkey").alias("v")).withColumn("ord", F.lit(2))
    return joins.latest(a.unionByName(b), "node", "v", ["ord"])


@query("SELECT doc_id, md5(replace(replace(text, '|', '\\|'), chr(10), '<br>')) AS digest, length(replace(replace(text, '|', '\\|'), chr(10), '<br>')) AS n FROM documents".replace("\\\\", "\\"))
def q_md_escape(spark, d):
    """S-37: table cells of Markdown."""
    v = text.markdown(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(v.cast("binary")).alias("digest"), F.length(v).cast("long").alias("n"))


@query("""SELECT doc_id, md5('"' || replace(text, '"', '""') || '"') AS digest FROM documents""")
def q_csv_quote(spark, d):
    """S-38: fields of CSV."""
    return read(spark, d, "documents").select("doc_id", F.md5(text.csv_field(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')) AS digest FROM pages""")
def q_xml_escape(spark, d):
    """S-40: text of XML."""
    return read(spark, d, "pages").select("page_id", F.md5(text.xml_escape(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT event_id, CASE WHEN value > 50 AND user_id % 4 <> 0 AND trim(event_type) <> '' AND event_type <> '*' THEN 't' || user_id || ':' || event_type ELSE 't' || user_id END AS destination FROM events")
def q_destination(spark, d):
    """S-24, S-25: topic and tag as one name."""
    tag = F.when((F.col("value") > 50) & (F.col("user_id") % 4 != 0), F.col("event_type")).when(F.col("user_id") % 4 == 0, "*").otherwise(" ")
    return read(spark, d, "events").select("event_id", text.destination(F.concat(F.lit("t"), F.col("user_id").cast("string")), tag).alias("destination"))


@query("SELECT n_nationkey, lower(n_name[1]) || substr(n_name, 2) AS bean, 'p::' || n_name || '#m(' || n_regionkey || ',int)' AS method_key FROM nation")
def q_names(spark, d):
    """S-4, S-9: bean names and method keys."""
    key = text.method_key(F.lit("p"), F.col("n_name"), F.lit("m"), F.array(F.col("n_regionkey").cast("string"), F.lit("int")))
    return read(spark, d, "nation").select("n_nationkey", text.decapitalize(F.col("n_name")).alias("bean"), key.alias("method_key"))



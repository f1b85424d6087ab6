"""Queries for rules: annotations, predicates, extraction rules, labels, and lookups over facts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.catalog import node, query, resource_rows
from ripplegraph.model import Options
from ripplegraph.operators import extractors, joins, reports, symbols
from ripplegraph.plans.engine import facts_of
from ripplegraph.storage import read

s = lambda c: F.col(c).cast("string")
none = lambda t: F.lit(None).cast(t)


@query("SELECT event_id, arg_max(p_partkey, (p_partkey - 1) * 10) AS enclosing FROM events LEFT JOIN part ON p_partkey * 10 - 10 <= event_id % 9000 AND event_id % 9000 <= p_partkey * 10 - 10 + p_size AND p_size % 4 = user_id % 4 GROUP BY event_id")
def q_enclosing(spark, d):
    """SC-11: the innermost method around a position of a file."""
    points = read(spark, d, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("file"), (F.col("event_id") % 9000).alias("at"))
    spans = read(spark, d, "part").select((F.col("p_size") % 4).cast("int").alias("file"), (F.col("p_partkey") * 10 - 10).alias("a"), (F.col("p_partkey") * 10 - 10 + F.col("p_size")).alias("b"), F.col("p_partkey").alias("enclosing"))
    return joins.enclosing(points, spans, ["file"], "at", "a", "b", "enclosing").select("event_id", "enclosing")


@query("""SELECT p_partkey FROM part WHERE CASE p_partkey % 4 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 0 WHEN 2 THEN true ELSE false END""")
def q_accessors(spark, d):
    """P-9: trivial getters and setters, by name, field and only statement."""
    p = read(spark, d, "part")
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, "getX").when(kind == 1, "setX").when(kind == 2, "isX").otherwise("getY")
    good = F.col("p_size") % 2 == 0
    stmt = F.when(kind == 0, F.when(good, "return  x ;").otherwise("return x + 1;")).when(kind == 1, F.when(good, "this.x = v;").otherwise("log(v);")).otherwise("return y;")
    owner = node("P", "p_partkey")
    method = p.select(F.lit("p").alias("project"), owner.alias("method_key"), owner.alias("class_fqn"), name.alias("name"), F.when(kind == 1, F.array(F.lit("int"))).otherwise(F.array().cast("array<string>")).alias("param_types"),
                      F.when(kind == 2, "boolean").when(kind == 1, "void").otherwise("int").alias("return_type"), F.array(F.lit("public")).alias("modifiers"), F.lit("").alias("text"), F.when(kind != 2, F.array(stmt)).alias("stmts"), F.lit(True).alias("is_project_source"), F.lit(0).alias("ord"))
    fields = p.select(owner.alias("symbol"), F.lit("field").alias("kind"), F.lit("x").alias("name"), owner.alias("owner_fqn"), F.lit("int").alias("type"), none("string").alias("init_expr_id"), F.lit(0).alias("ord"))
    return symbols.accessors(facts_of(spark, {"method": method, "variable": fields})).select(F.regexp_extract("method_key", r"(\d+)$", 1).cast("long").alias("p_partkey"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'HEAD' ELSE '未声明' END END AS verb,
CASE c_custkey % 5 WHEN 0 THEN 'svc' || c_nationkey || '/v1' WHEN 1 THEN '待确认服务' ELSE 'svc' || c_nationkey END AS service,
CASE c_custkey % 5 WHEN 0 THEN '/v1' ELSE '' END || '/base/m' || c_custkey AS path FROM customer""")
def q_declared_clients(spark, d):
    """P-25, S-12, S-31, S-32, O-7: declared HTTP clients, by annotation and priority of attributes."""
    c = read(spark, d, "customer")
    cls, key, kind = node("C", "c_custkey"), F.concat(node("C", "c_custkey"), F.lit("#m")), F.col("c_custkey") % 5
    name = F.concat(F.lit("svc"), s("c_nationkey"))
    given = F.when(kind == 0, F.create_map(F.lit("name"), F.array(F.lit(" ")), F.lit("value"), F.array(F.concat(name, F.lit("/v1"))))).when(kind == 1, F.create_map(F.lit("path"), F.array(F.lit("x")))).otherwise(F.create_map(F.lit("name"), F.array(name), F.lit("url"), F.array(F.lit("http://u"))))
    base = F.create_map(F.lit("path"), F.array(F.lit("/base/")))
    row = lambda target_kind, target, short, attrs, declared, said: c.select(F.lit("p").alias("project"), F.lit(target_kind).alias("target_kind"), target.alias("target_id"), F.lit(0).alias("ord"), F.concat(F.lit("x."), short).alias("fqn"), short.alias("short_name"), attrs.alias("attrs"), declared.alias("declared_attrs"), said.alias("attr_text"))
    verb = F.when(F.col("c_custkey") % 3 == 0, "GetMapping").when(F.col("c_custkey") % 3 == 1, "PutMapping").otherwise("RequestMapping")
    said = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("method"), F.lit("RequestMethod.HEAD"))).otherwise(F.create_map(F.lit("method"), F.lit("")))
    path = F.create_map(F.lit("value"), F.array(F.concat(F.lit("m"), s("c_custkey"))))
    notes = row("class", cls, F.lit("FeignClient"), base, given, none("map<string,string>")).unionByName(row("method", key, verb, path, path, said))
    methods = c.select(F.lit("p").alias("project"), key.alias("method_key"), cls.alias("class_fqn"), F.lit("m").alias("name"), F.array().cast("array<string>").alias("param_types"), F.lit("void").alias("return_type"), F.array().cast("array<string>").alias("modifiers"), F.lit("").alias("text"), F.array().cast("array<string>").alias("stmts"), F.lit(True).alias("is_project_source"), F.lit(0).alias("ord"))
    found = extractors.feign_endpoints(facts_of(spark, {"annotation": notes, "method": methods}))
    return found.select(F.regexp_extract("target_key", r"(\d+)#", 1).cast("long").alias("c_custkey"), "verb", "service", "path")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'const' WHEN 1 THEN 'const' WHEN 2 THEN '${v.' || o_custkey || '}' WHEN 3 THEN 'const' END AS value FROM orders WHERE o_orderkey % 5 <> 4""")
def q_expression_values(spark, d):
    """G-4, J-16, S-8, S-27: constants, variables that lead to them, injected fields; cycles lead nowhere."""
    o = read(spark, d, "orders")
    k, kind = s("o_orderkey"), F.col("o_orderkey") % 5
    e = lambda tag, const, ref: o.select(F.concat(F.lit(tag), k).alias("expr_id"), F.lit("ref").alias("kind"), F.lit("").alias("text"), const.alias("const_value"), ref.alias("ref_symbol"), F.array().cast("array<string>").alias("operands"))
    exprs = e("a", F.when(kind == 0, "const"), F.when(kind > 0, F.concat(F.lit("v"), k))).unionByName(e("b", F.when(kind == 1, "const"), F.when(kind >= 3, F.concat(F.lit("w"), k)))).unionByName(e("c", F.when(kind == 3, "const"), F.when(kind == 4, F.concat(F.lit("v"), k))))
    v = lambda tag, init, field: o.select(F.concat(F.lit(tag), k).alias("symbol"), F.lit(field).alias("kind"), F.lit("x").alias("name"), F.lit("C").alias("owner_fqn"), F.lit("s").alias("type"), init.alias("init_expr_id"), F.lit(0).alias("ord"))
    variables = v("v", F.concat(F.lit("b"), k), "local").unionByName(v("w", F.concat(F.lit("c"), k), "local"))
    attrs = F.create_map(F.lit("value"), F.array(F.concat(F.lit("${v."), s("o_custkey"), F.lit("}"))))
    notes = o.filter(kind == 2).select(F.lit("p").alias("project"), F.lit("field").alias("target_kind"), F.concat(F.lit("v"), k).alias("target_id"), F.lit(0).alias("ord"), F.lit("x.Value").alias("fqn"), F.lit("Value").alias("short_name"), attrs.alias("attrs"), attrs.alias("declared_attrs"), none("map<string,string>").alias("attr_text"))
    found = symbols.expression_values(facts_of(spark, {"expr": exprs, "variable": variables, "annotation": notes})).filter("expr_id like 'a%'")
    return found.select(F.substring("expr_id", F.lit(2), F.length("expr_id")).cast("long").alias("o_orderkey"), "value")


@query("SELECT n_nationkey, 'E' || n_nationkey AS entity FROM nation")
def q_generic_entities(spark, d):
    """G-9, J-14, S-33, S-47: a type argument carried up two levels of a hierarchy to the marker type."""
    n = read(spark, d, "nation")
    i = s("n_nationkey")
    arr = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    sup = lambda c, p, args: n.select(F.lit("p").alias("project"), F.concat(F.lit(c), i).alias("class_fqn"), (F.concat(F.lit(p), i) if p != "x.BaseMapper" else F.lit(p)).alias("super_fqn"), args.alias("type_args"), F.lit(0).alias("ord"))
    supertypes = sup("Dao", "Base", arr("java.lang.Long", F.concat(F.lit("E"), i))).unionByName(sup("Base", "x.BaseMapper", arr("T")))
    cls = lambda c, params: n.select(F.lit("p").alias("project"), F.concat(F.lit(c), i).alias("class_fqn"), F.concat(F.lit(c), i).alias("short_name"), F.lit("class").alias("kind"), F.lit(False).alias("is_abstract"), F.lit(False).alias("is_final"), params.alias("type_params"), F.lit(True).alias("is_project_source"))
    classes = cls("Dao", F.array().cast("array<string>")).unionByName(cls("Base", arr("ID", "T")))
    starts = n.select(i.alias("start"), F.concat(F.lit("Dao"), i).alias("class_fqn"), none("array<string>").alias("args"))
    up = symbols.ancestors(facts_of(spark, {"supertype": supertypes, "src_class": classes}), starts)
    return up.filter("class_fqn = 'x.BaseMapper'").select(F.col("start").cast("int").alias("n_nationkey"), F.col("args")[0].alias("entity"))


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 3 = 1 OR s_suppkey % 6 = 2 AS hit FROM supplier""")
def q_configured_names(spark, d):
    """P-18, P-20: configured classes by full name, short name, or the end of the name."""
    k = F.col("s_suppkey")
    fqn = F.when(k % 3 == 0, "com.acme.Sender").when(k % 3 == 1, "org.lib.mq.Producer").otherwise(F.when(k % 6 == 2, "a.b.c.Deep").otherwise("com.acme.SenderX"))
    hit = symbols.configured(("com.acme.Sender", "Producer", "c.Deep"), F.col("fqn"), F.element_at(F.split("fqn", r"\."), -1))
    return read(spark, d, "supplier").select("s_suppkey", fqn.alias("fqn")).select("s_suppkey", hit.alias("hit"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN '写入' ELSE '只读' END AS operation_label, CASE l_returnflag WHEN 'A' THEN '已确认' WHEN 'N' THEN '推断' ELSE '待确认' END AS confidence_label FROM lineitem""")
def q_labels(spark, d):
    """S-43, SK-8, P-26: codes as labels."""
    r = read(spark, d, "lineitem")
    op = F.when(F.col("l_linestatus") == "F", "WRITE").otherwise("READ")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return r.select("l_orderkey", "l_linenumber", reports.operation_label(F.lit("MYSQL"), op).alias("operation_label"), reports.label_of(rank, {0: "已确认", 1: "推断", 2: "待确认"}).alias("confidence_label"))


@query("""WITH r AS (SELECT 'P:'||l_partkey AS name, MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS w, MAX(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS rd FROM lineitem GROUP BY 1)
SELECT name, concat_ws(chr(10), CASE WHEN rd = 1 THEN '只读：' || name END, CASE WHEN w = 1 THEN '写入：' || name END) AS cell FROM r""")
def q_operation_lines(spark, d):
    """A-15 to A-17: names by operation, a line each."""
    r = resource_rows(spark, d).groupBy("type", "name", "operation").agg(F.max("conf_rank").alias("conf_rank"), F.lit("").alias("detail"))
    r = r.withColumns({"root_id": F.col("name"), "ord": F.when(F.col("operation") == "READ", 0).otherwise(1)})
    return reports.operation_groups(r, "MYSQL").select(F.col("root_id").alias("name"), "cell")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'REDIS' WHEN 1 THEN 'KAFKA' WHEN 2 THEN 'RABBITMQ' ELSE 'ROCKETMQ' END AS type,
CASE event_id % 4 WHEN 0 THEN 'k' || user_id WHEN 1 THEN 'k' || user_id WHEN 2 THEN 'k' || user_id || ' -> tag' ELSE 'k' || user_id || ':tag' END AS name,
CASE event_id % 4 WHEN 0 THEN 'WRITE' WHEN 3 THEN 'CONSUME' ELSE 'PRODUCE' END AS operation, CASE event_id % 4 WHEN 3 THEN 0 ELSE 1 END AS conf_rank FROM events""")
def q_call_rules(spark, d):
    """X-4: caches and queues by the class and the name of a call, and its known arguments."""
    e = read(spark, d, "events")
    kind, cid = F.col("event_id") % 4, F.concat(F.lit("e"), s("event_id"))
    target = F.when(kind == 0, "x.RedisTemplate#set").when(kind == 1, "x.KafkaTemplate#send").when(kind == 2, "x.RabbitTemplate#convertAndSend").otherwise("org.apache.rocketmq.Consumer#subscribe")
    empty = F.array().cast("array<string>")
    calls = e.select(F.lit("p").alias("project"), cid.alias("call_id"), F.lit("a.A#run").alias("caller_key"), F.lit(0).alias("ord"), F.lit("call").alias("kind"), target.alias("callee_key"), none("string").alias("ref_name"), F.lit("call").alias("text"), none("string").alias("qualifier_type"), empty.alias("qualifier_type_args"), none("string").alias("qualifier_symbol"))
    arg = lambda pos: e.select(cid.alias("call_id"), F.lit(pos).alias("pos"), F.concat(cid, F.lit(f"-{pos}")).alias("expr_id"), F.lit("s").alias("type_fqn"), empty.alias("type_args"))
    value = lambda pos, v: e.select(F.concat(cid, F.lit(f"-{pos}")).alias("expr_id"), F.lit("literal").alias("kind"), F.lit("x").alias("text"), v.alias("const_value"), none("string").alias("ref_symbol"), empty.alias("operands"))
    methods = [("p", k, k.split("#")[0], k.split("#")[1], [], "void", ["public"], "", ["x"], k.startswith("a."), 0) for k in ("a.A#run", "x.RedisTemplate#set", "x.KafkaTemplate#send", "x.RabbitTemplate#convertAndSend", "org.apache.rocketmq.Consumer#subscribe")]
    facts = facts_of(spark, {"call_site": calls, "method": methods, "call_arg": arg(0).unionByName(arg(1)), "expr": value(0, F.concat(F.lit("k"), s("user_id"))).unionByName(value(1, F.lit("tag")))})
    found = extractors.infrastructure(extractors.contexts(facts, Options())).filter("ctx_id like 'c|%'")
    return found.select(F.regexp_extract("ctx_id", r"(\d+)$", 1).cast("long").alias("event_id"), "type", "name", "operation", "conf_rank")



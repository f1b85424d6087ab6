"""Queries that run the extractors, dispatch and the engine over facts made from the tables, one case a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.catalog import query
from ripplegraph.model import FACTS, Options
from ripplegraph.operators import extractors, symbols
from ripplegraph.plans.engine import dispatch_roots, facts_of
from ripplegraph.storage import materialize, read

BLANK = {"project": "p", "ord": 0, "kind": "call", "is_project_source": True, "is_abstract": False, "is_final": False, "return_type": "void", "text": "", "target_kind": "method", "pos": 0}


def fact(df: DataFrame, table: str, **given) -> DataFrame:
    """Rows of a fact table from ``df``: columns given as they are or as values, the others blank."""
    out = []
    for field in FACTS[table].split(", "):
        name, kind = field.split(" ", 1)
        value = given.get(name, BLANK.get(name))
        if isinstance(value, (list, tuple)):
            value = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in value])
        out.append((value if isinstance(value, Column) else F.lit(value)).cast(kind.lower()).alias(name))
    return df.select(*out)


def both(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def cat(*parts) -> Column:
    """Text of columns and strings put together; ``$c`` stands for a column."""
    return F.concat(*[F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("$") and p[1:2].isalpha() else p if isinstance(p, Column) else F.lit(p) for p in parts])


def note(df: DataFrame, kind: str, target: Column, short: str, **attributes) -> DataFrame:
    """An annotation; attribute values are columns or strings."""
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), F.array(v if isinstance(v, Column) else F.lit(v)))]
    attrs = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    return fact(df, "annotation", target_kind=kind, target_id=target, fqn=f"x.{short}", short_name=short, attrs=attrs, declared_attrs=attrs)


class Cases:
    """Facts in the making: each case adds rows for the rows of ``df`` that it is about."""

    def __init__(self, spark, key: str):
        self.spark, self.key, self.tables = spark, key, {}

    def add(self, table: str, df: DataFrame, **given) -> None:
        self.tables.setdefault(table, []).append(fact(df, table, **given))

    def note(self, df: DataFrame, kind: str, target: Column, short: str, **attributes) -> None:
        self.tables.setdefault("annotation", []).append(note(df, kind, target, short, **attributes))

    def method(self, df: DataFrame, owner, name: str, **given) -> Column:
        """A method of a class; its key."""
        owner = owner if isinstance(owner, Column) else F.lit(owner)
        key = F.concat(owner, F.lit(f"#{name}"))
        self.add("method", df, **({"method_key": key, "class_fqn": owner, "name": name, "modifiers": ["public"], "stmts": ["x"], "param_types": []} | given))
        return key

    def once(self) -> DataFrame:
        return self.spark.range(1)

    def call(self, df: DataFrame, callee: str | Column, arguments=(), **given) -> None:
        """A call in method a.C<key>#run of each row; arguments are (constant or None, text, fields of the expression)."""
        owner = cat("a.C", f"${self.key}")
        cid = cat("k", f"${self.key}")
        self.method(df, owner, "run")
        self.add("call_site", df, **({"call_id": cid, "caller_key": F.concat(owner, F.lit("#run")), "callee_key": callee, "text": "call()"} | given))
        for pos, (const, said, more) in enumerate(arguments):
            expr = cat(cid, f"-{pos}")
            own = {k: more[k] for k in ("type_fqn", "type_args") if k in more}
            self.add("call_arg", df, **({"call_id": cid, "pos": pos, "expr_id": expr, "type_fqn": "s", "type_args": []} | own))
            self.add("expr", df, **({"expr_id": expr, "kind": "literal", "text": said, "const_value": const, "operands": []} | {k: v for k, v in more.items() if k not in own}))

    def library(self, *keys: str) -> None:
        for key in keys:
            self.method(self.once(), key.split("#")[0], key.split("#")[1], is_project_source=False)

    def facts(self):
        return facts_of(self.spark, {name: materialize(both(parts), name) for name, parts in self.tables.items()})


def told(found: DataFrame, key: str) -> DataFrame:
    """Resources by the number of the case that they come from."""
    number = F.regexp_extract("ctx_id", r"(\d+)", 1)
    return found.filter(number != "").select(number.try_cast("long").alias(key), "type", "name", "operation", "conf_rank", "detail").distinct()


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 16 AS kind FROM part)
SELECT k AS p_partkey, CASE WHEN kind IN (0, 1, 2) THEN 'REDIS' WHEN kind IN (3, 4, 5, 6, 14, 15) THEN 'ROCKETMQ' WHEN kind IN (7, 8, 11) THEN 'KAFKA' ELSE 'RABBITMQ' END AS type,
CASE kind WHEN 0 THEN 'c' || z WHEN 1 THEN 'k' || z WHEN 2 THEN 'expr' || z || '()' WHEN 3 THEN 't' || z || ':g' WHEN 4 THEN 't' || z WHEN 5 THEN '动态 RocketMQ destination: T.X' || z WHEN 6 THEN 'd' || z WHEN 7 THEN '${t.' || z || '}'
  WHEN 8 THEN '${kt}' WHEN 9 THEN 'q' || z WHEN 10 THEN 'e' || z || ' -> key' WHEN 11 THEN 't' || z WHEN 12 THEN 'q' || z WHEN 13 THEN 'q' || z WHEN 14 THEN 't' || z || ':s' ELSE 't' || z || ':g' END AS name,
CASE WHEN kind = 0 THEN 'UNKNOWN' WHEN kind IN (1, 2) THEN 'READ' WHEN kind IN (3, 5, 6, 7, 8, 9, 10) THEN 'PRODUCE' ELSE 'CONSUME' END AS operation,
CAST(CASE WHEN kind IN (2, 5) THEN 2 WHEN kind IN (1, 10, 15) THEN 1 ELSE 0 END AS INT) AS conf_rank,
CASE kind WHEN 0 THEN 'Spring Cache 注解' WHEN 1 THEN 'x.RedisTemplate.get' WHEN 2 THEN 'x.RedisTemplate.get' WHEN 3 THEN 'org.apache.rocketmq.P.send；从 ONS/RocketMQ Message 构造参数解析' WHEN 4 THEN 'org.apache.rocketmq.P.subscribe'
  WHEN 5 THEN 'w.Sender.sendMsg；从 RocketMQ 包装器参数解析' WHEN 6 THEN 'x.RocketMQTemplate.syncSend' WHEN 7 THEN 'x.KafkaTemplate.send' WHEN 8 THEN 'x.KafkaHelper.push' WHEN 9 THEN '@QueueOut out' WHEN 10 THEN 'x.RabbitTemplate.convertAndSend'
  WHEN 11 THEN '@KafkaListener' WHEN 12 THEN 'Rabbit consumer annotation' WHEN 13 THEN '自定义 MQ 消费者注解' WHEN 14 THEN '@RocketMQMessageListener' ELSE '自定义 MQ 消费者接口 topic()/tag()' END AS detail FROM c""")
def q_infrastructure_rules(spark, d):
    """X-4, X-4a to X-4n, S-25, S-26, S-28, S-29, P-18, P-19, J-18, J-19, J-21: every rule for caches, queues and topics, with its evidence."""
    return told(extractors.infrastructure(infrastructure_cases(spark, d)), "p_partkey")


def infrastructure_cases(spark, d):
    p = read(spark, d, "part").withColumn("kind", F.col("p_partkey") % 16)
    on = lambda k: p.filter(F.col("kind") == k)
    c = Cases(spark, "p_partkey")
    owner = cat("a.C", "$p_partkey")
    c.library("x.RedisTemplate#get", "org.apache.rocketmq.P#send", "org.apache.rocketmq.P#subscribe", "w.Sender#sendMsg", "x.RocketMQTemplate#syncSend", "x.KafkaTemplate#send", "x.KafkaHelper#push", "y.Out#emit", "x.RabbitTemplate#convertAndSend")
    z = lambda letter: cat(letter, "$p_size")
    run = lambda k, name="run", **more: c.method(on(k), owner, name, **more)
    c.note(on(0), "method", run(0), "Cacheable", value=z("c"))
    c.call(on(1), "x.RedisTemplate#get", [(z("k"), "x", {})])
    c.call(on(2), "x.RedisTemplate#get", [(None, cat("expr", "$p_size", "()"), {"kind": "call"})])
    message, symbol = cat("new", "$p_partkey"), cat("v", "$p_partkey")
    c.call(on(3), "org.apache.rocketmq.P#send", [(None, "message", {"kind": "ref", "ref_symbol": symbol})])
    c.add("variable", on(3), symbol=symbol, kind="local", name="message", owner_fqn=owner, type="Message", init_expr_id=message)
    c.add("expr", on(3), expr_id=message, kind="new", text="new Message(..)", ref_symbol="org.apache.rocketmq.Message", operands=[cat(message, "-t"), cat(message, "-g")])
    c.add("expr", on(3), expr_id=cat(message, "-t"), kind="literal", text="t", const_value=z("t"), operands=[])
    c.add("expr", on(3), expr_id=cat(message, "-g"), kind="literal", text="g", const_value="g", operands=[])
    c.call(on(4), "org.apache.rocketmq.P#subscribe", [(z("t"), "t", {}), ("*", "*", {})])
    c.call(on(5), "w.Sender#sendMsg", [(None, cat("T.X", "$p_size"), {"kind": "ref"}), ("g", "g", {})])
    c.call(on(6), "x.RocketMQTemplate#syncSend", [(z("d"), "d", {})])
    c.call(on(7), "x.KafkaTemplate#send", [(cat("${t.", "$p_size", "}"), "t", {})])
    c.call(on(8), "x.KafkaHelper#push", [(None, "m", {"kind": "ref"})])
    c.add("variable", c.once(), symbol="f:kt", kind="field", name="orderTopic", owner_fqn="x.KafkaHelper", type="s")
    c.note(c.once(), "field", F.lit("f:kt"), "Value", value="${kt}")
    field = cat("f", "$p_partkey")
    c.call(on(9), "y.Out#emit", qualifier_symbol=field)
    c.add("variable", on(9), symbol=field, kind="field", name="out", owner_fqn=owner, type="y.Out")
    c.note(on(9), "field", field, "QueueOut", queue=z("q"))
    c.call(on(10), "x.RabbitTemplate#convertAndSend", [(z("e"), "e", {}), ("key", "k", {})])
    c.note(on(11), "method", run(11), "KafkaListener", topics=z("t"))
    c.note(on(12), "method", run(12), "RabbitListener", queues=z("q"))
    run(13)
    c.note(on(13), "class", owner, "QueueIn", queue=z("q"))
    run(14, "onMessage")
    c.note(on(14), "class", owner, "RocketMQMessageListener", topic=z("t"), selectorExpression="s")
    run(15, "consume")
    run(15, "topic", text="String topic() { return Names.TOPIC; }")
    run(15, "tag", text='String tag() { return "g"; }')
    c.add("supertype", on(15), class_fqn=owner, super_fqn="i.Listener", type_args=[])
    c.add("variable", on(15), symbol=cat("t", "$p_partkey"), kind="field", name="TOPIC", owner_fqn=owner, type="s", init_expr_id=cat("ti", "$p_partkey"))
    c.add("expr", on(15), expr_id=cat("ti", "$p_partkey"), kind="literal", text="t", const_value=z("t"), operands=[])
    options = Options(producer_annotations=("QueueOut",), consumer_annotations=("QueueIn",), producer_classes=("w.Sender",), consumer_interfaces=("i.Listener",))
    return extractors.contexts(c.facts(), options)


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 11 AS kind FROM part)
SELECT k AS p_partkey, 'MYSQL' AS type, CASE kind WHEN 0 THEN 't_' || z WHEN 1 THEN 't_' || z WHEN 2 THEN 't_' || z WHEN 3 THEN 'tbl_' || z WHEN 4 THEN 'order_item' || k WHEN 5 THEN 'tbl_' || z WHEN 6 THEN 'plain' || k WHEN 7 THEN 'tbl_' || z WHEN 8 THEN 't_' || z WHEN 9 THEN 'ent_' || z ELSE 'ent_' || z END AS name,
CASE WHEN kind IN (0, 1, 2, 3, 5, 6, 10) THEN CASE kind WHEN 2 THEN 'WRITE' ELSE 'READ' END ELSE 'WRITE' END AS operation,
CAST(CASE WHEN kind = 1 THEN 2 WHEN kind IN (2, 3, 4, 6) THEN 1 ELSE 0 END AS INT) AS conf_rank,
CASE kind WHEN 0 THEN 'MyBatis m.P' || k || 'Mapper#q' WHEN 1 THEN 'MyBatis m.P' || k || 'Mapper#q；包含动态表名表达式' WHEN 2 THEN 'MyBatis m.P' || k || 'Mapper#q；SQL 解析失败，使用后备识别'
  WHEN 3 THEN 'MyBatis 通用 Mapper tk.mybatis.mapper.common.Mapper#selectByPrimaryKey；XML/Provider 未解析出表，按调用点泛型实体推断' WHEN 4 THEN 'MyBatis 通用 Mapper m.OrderItem' || k || 'Mapper#insertSelective；XML/Provider 未解析出表，按调用点泛型实体推断'
  WHEN 5 THEN 'MyBatis-Plus com.b.BaseMapper.selectById；实体 e.Ent' || k || '；@TableName/@Table' WHEN 6 THEN 'MyBatis-Plus com.b.IService.list；实体 e.Plain' || k || '；按默认命名规则推断' WHEN 7 THEN 'MyBatis-Plus com.b.Db.removeById；实体 e.Ent' || k || '；@TableName/@Table'
  WHEN 8 THEN 'JPA native query r.Rep' || k || '.wipe' WHEN 9 THEN 'JPA Repository r.E' || k || 'Repository.save；实体注解表名' ELSE 'JPA Repository r.E' || k || 'Repository.find；实体注解表名' END AS detail FROM c""")
def q_orm_rules(spark, d):
    """X-1, X-2, X-3, X-6, P-13 to P-17, P-26, S-33 to S-35, S-47, J-11, J-13, J-14: statements, generated mappers, ORM calls and repositories."""
    c = extractors.contexts(orm_cases(spark, d), Options())
    return both([told(e(c), "p_partkey") for e in (extractors.mybatis, extractors.mybatis_plus, extractors.jpa)])


def orm_cases(spark, d):
    p = read(spark, d, "part").withColumn("kind", F.col("p_partkey") % 11)
    on = lambda *k: p.filter(F.col("kind").isin(*k))
    c = Cases(spark, "p_partkey")
    k = "$p_partkey"
    c.library("tk.mybatis.mapper.common.Mapper#selectByPrimaryKey", "com.b.BaseMapper#selectById", "com.b.IService#list", "com.b.Db#removeById")
    for fqn, params in (("tk.mybatis.mapper.common.Mapper", ["T"]), ("com.b.BaseMapper", ["T"]), ("com.b.IService", ["T"]), ("com.b.Db", [])):
        c.add("src_class", c.once(), class_fqn=fqn, short_name=fqn.rsplit(".", 1)[1], kind="interface", type_params=params, is_project_source=False)
    mapper = cat("m.P", k, "Mapper")
    c.method(on(0, 1, 2), mapper, "q")
    sql = F.when(F.col("kind") == 0, cat("select * from t_", "$p_size", " where id = #{id}")).when(F.col("kind") == 1, cat("select * from t_", "$p_size", " order by ${o}")).otherwise(cat("go (( from t_", "$p_size"))
    c.add("mapper_file", on(0, 1, 2), path=mapper, text=F.concat(F.lit("<mapper namespace='"), mapper, F.lit("'><select id='q'>"), sql, F.lit("</select></mapper>")))
    entity = cat("e.Ent", k)
    c.add("src_class", on(3, 5, 7), class_fqn=entity, short_name=cat("Ent", k), kind="class", type_params=[])
    c.note(on(3, 5, 7), "class", entity, "TableName", value=cat("tbl_", "$p_size"))
    dao = cat("d.Dao", k)
    c.add("supertype", on(3), class_fqn=dao, super_fqn="tk.mybatis.mapper.common.Mapper", type_args=[entity])
    c.call(on(3), "tk.mybatis.mapper.common.Mapper#selectByPrimaryKey", qualifier_type=dao)
    c.method(on(4), cat("m.OrderItem", k, "Mapper"), "insertSelective")
    c.add("supertype", on(5), class_fqn=dao, super_fqn="com.b.BaseMapper", type_args=[entity])
    c.call(on(5), "com.b.BaseMapper#selectById", [("1", "1L", {"type_fqn": "java.lang.Long"})], qualifier_type=dao)
    plain = cat("e.Plain", k)
    c.add("src_class", on(6), class_fqn=plain, short_name=cat("Plain", k), kind="class", type_params=[])
    c.call(on(6), "com.b.IService#list", [(None, "w", {"type_fqn": "T", "kind": "ref"}), (None, "w", {"type_fqn": "c.LambdaQueryWrapper", "type_args": [plain], "kind": "ref"})])
    c.call(on(7), "com.b.Db#removeById", [("1", "1L", {"type_fqn": "java.lang.Long"}), (None, "Ent.class", {"kind": "class_literal", "ref_symbol": entity})])
    c.note(on(8), "method", c.method(on(8), cat("r.Rep", k), "wipe"), "Query", nativeQuery="true", value=cat("delete from t_", "$p_size"))
    repository, row = cat("r.E", k, "Repository"), cat("e.Row", k)
    c.add("src_class", on(9, 10), class_fqn=row, short_name=cat("Row", k), kind="class", type_params=[])
    c.note(on(9, 10), "class", row, "Entity", name=cat("ent_", "$p_size"))
    c.method(on(9), repository, "save")
    c.add("supertype", on(9), class_fqn=repository, super_fqn="org.x.JpaRepository", type_args=[row, F.lit("java.lang.Long")])
    c.method(on(10), repository, "find", param_types=["java.lang.Long"], return_type=row)
    return c.facts()


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 6 AS kind FROM customer)
SELECT k AS c_custkey, 'EXTERNAL_HTTP' AS type, CASE kind WHEN 0 THEN 'POST http://h' || n || '/p' WHEN 1 THEN 'GET 待确认URL' WHEN 2 THEN 'GET http://in' || n || '/p' WHEN 3 THEN 'DELETE http://h' || n || '/100%/x' WHEN 4 THEN 'svc' || n || ' PUT /base/m' || k ELSE '${svc.name} GET /' END AS name,
'CALL' AS operation, CAST(CASE WHEN kind IN (1, 5) THEN 2 WHEN kind = 4 THEN 0 ELSE 1 END AS INT) AS conf_rank,
CASE kind WHEN 0 THEN 'HTTP client x.RestTemplate.postForObject' WHEN 1 THEN 'HTTP client own.http.Client.getIt' WHEN 2 THEN 'HTTP client x.RestTemplate.getForObject；配置解析：${host.h' || n || '}/p -> http://in' || n || '/p'
  WHEN 3 THEN 'HTTP client x.OkHttpClient.delete' ELSE 'Feign FeignClient c.F' || k || '.m' END AS detail FROM c""")
def q_external_http(spark, d):
    """X-5, P-22, P-25, S-11 to S-16, S-31, J-15, J-16: declared clients and client classes, addresses from constants, variables, fields and formats, evidence of what configuration changed."""
    p = read(spark, d, "customer").withColumn("kind", F.col("c_custkey") % 6)
    on = lambda *k: p.filter(F.col("kind").isin(*k))
    c = Cases(spark, "c_custkey")
    k, n = "$c_custkey", "$c_nationkey"
    c.library("x.RestTemplate#postForObject", "x.RestTemplate#getForObject", "own.http.Client#getIt", "x.OkHttpClient#delete")
    c.call(on(0), "x.RestTemplate#postForObject", [(None, "u", {"kind": "ref", "ref_symbol": cat("v", k)})])
    c.add("variable", on(0), symbol=cat("v", k), kind="local", name="u", init_expr_id=cat("i", k))
    c.add("expr", on(0), expr_id=cat("i", k), kind="literal", text="u", const_value=cat("http://h", n, "/p"), operands=[])
    c.call(on(1), "own.http.Client#getIt", [(None, "u", {"kind": "ref", "ref_symbol": cat("v", k)})])
    c.add("variable", on(1), symbol=cat("v", k), kind="field", name="u", init_expr_id=cat("i", k))  # fields aren't followed but by their annotation
    c.add("expr", on(1), expr_id=cat("i", k), kind="literal", text="u", const_value="http://no", operands=[])
    c.call(on(2), "x.RestTemplate#getForObject", [(None, "h + p", {"kind": "polyadic", "operands": [cat("h", k), cat("q", k), cat("r", k)]})])
    c.add("expr", on(2), expr_id=cat("h", k), kind="ref", text="h", ref_symbol=cat("f", k), operands=[])
    c.add("expr", on(2), expr_id=cat("q", k), kind="literal", text="p", const_value="/p", operands=[])
    c.add("expr", on(2), expr_id=cat("r", k), kind="ref", text="unknown", operands=[])
    c.add("variable", on(2), symbol=cat("f", k), kind="field", name="host")
    c.note(on(2), "field", cat("f", k), "Value", value=cat("${host.h", n, "}"))
    c.call(on(3), "x.OkHttpClient#delete", [(None, "format", {"kind": "format", "operands": [cat("t", k), cat("a", k)]})])
    c.add("expr", on(3), expr_id=cat("t", k), kind="literal", text="t", const_value="http://%s/100%%/x", operands=[])
    c.add("expr", on(3), expr_id=cat("a", k), kind="literal", text="a", const_value=cat("h", n), operands=[])
    client = cat("c.F", k)
    key = c.method(on(4, 5), client, "m")
    c.note(on(4), "class", client, "FeignClient", name=cat("svc", n), path="/base/")
    c.note(on(4), "method", key, "PutMapping", path=cat("m", k), value="other")
    c.note(on(5), "class", client, "FeignClient", value="${svc.name}")
    c.note(on(5), "method", key, "GetMapping")
    lines = read(spark, d, "nation").orderBy("n_nationkey").select(cat("host.h", "$n_nationkey", "=http://${inner.h", "$n_nationkey", "}").alias("l"), cat("inner.h", "$n_nationkey", "=in", "$n_nationkey").alias("m"))
    joined = lines.agg(F.array_join(F.array_sort(F.collect_list(F.concat("l", F.lit("\n"), "m"))), "\n").alias("text"))
    c.add("config_file", joined, path="a.properties", ext_rank=0, text=F.col("text"))
    found = extractors.external_http(extractors.contexts(c.facts(), Options(http_client_prefixes=("own.http.",))))
    return told(found, "c_custkey")


SERVICES = """svc AS (SELECT n_nationkey AS n, n_nationkey % 5 = 0 AS abstract_one, n_nationkey % 3 = 0 AS asked FROM nation),
impl AS (SELECT s_nationkey AS n, s_suppkey AS s, s_suppkey % 7 = 0 AS is_primary, s_suppkey % 11 = 0 AS abstract_impl FROM supplier),
cand AS (SELECT svc.*, s, is_primary FROM svc JOIN impl USING (n) WHERE NOT abstract_impl),
cnt AS (SELECT *, COUNT(*) OVER (PARTITION BY n) AS c, bool_or(asked AND s = first_s) OVER (PARTITION BY n) AS named, SUM(CAST(is_primary AS INT)) OVER (PARTITION BY n) AS prims FROM (SELECT *, MIN(s) OVER (PARTITION BY n) AS first_s FROM cand)),
kept AS (SELECT n, s FROM cnt WHERE CASE WHEN c = 1 THEN true WHEN named THEN asked AND s = first_s WHEN prims = 1 THEN is_primary ELSE true END)"""


def service_facts(spark, d):
    """An interface method a nation, an implementation a supplier, some abstract, some primary, some asked for by name; and a concrete method that others override."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    c = Cases(spark, "n_nationkey")
    face, impl = cat("i.N", "$n_nationkey"), cat("a.S", "$s_suppkey")
    c.add("src_class", n, class_fqn=face, short_name=cat("N", "$n_nationkey"), kind="interface", type_params=[])
    c.add("src_class", s, class_fqn=impl, short_name=cat("S", "$s_suppkey"), kind="class", type_params=[])
    c.method(n, face, "run")
    abstract = F.when(F.col("s_suppkey") % 11 == 0, F.array(F.lit("abstract"))).otherwise(F.array(F.lit("public")))
    c.method(s, impl, "run", modifiers=abstract)
    c.add("override", s, super_method_key=cat("i.N", "$s_nationkey", "#run"), impl_method_key=cat(impl, "#run"))
    c.note(s.filter("s_suppkey % 7 = 0"), "class", impl, "Primary")
    c.note(s, "class", impl, "Service", value=cat("bean", "$s_suppkey"))
    first = s.filter("s_suppkey % 11 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("first"))
    asked = n.filter("n_nationkey % 3 = 0").join(first, "n_nationkey")
    c.note(asked, "field", cat("f", "$n_nationkey"), "Resource", name=cat("bean", "$first"))
    c.method(n, cat("c.C", "$n_nationkey"), "run")
    c.add("call_site", n, call_id=cat("k", "$n_nationkey"), caller_key=cat("c.C", "$n_nationkey", "#run"), callee_key=cat(face, "#run"), qualifier_symbol=F.when(F.col("n_nationkey") % 3 == 0, cat("f", "$n_nationkey")))
    base, sub = cat("b.Base", "$n_nationkey"), cat("b.Sub", "$n_nationkey")
    hidden = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("private"))).when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("static"))).otherwise(F.array(F.lit("public")))
    c.method(n, base, "go", modifiers=hidden)
    c.method(n, sub, "go")
    c.add("src_class", n, class_fqn=base, short_name="Base", kind="class", type_params=[], is_final=F.col("n_nationkey") % 4 == 2)
    c.add("override", n, super_method_key=cat(base, "#go"), impl_method_key=cat(sub, "#go"))
    c.add("call_site", n, call_id=cat("g", "$n_nationkey"), caller_key=cat("c.C", "$n_nationkey", "#run"), callee_key=cat(base, "#go"))
    return c.facts()


@query(f"""WITH {SERVICES}, t AS (SELECT n, COUNT(*) AS c FROM kept GROUP BY n)
SELECT 'i.N' || n || '#run' AS callee_key, 'a.S' || s || '#run' AS target_key, CASE WHEN c = 1 THEN '唯一实现类' ELSE '接口存在多个实现' END AS reason FROM kept JOIN t USING (n)
UNION ALL SELECT 'i.N' || n || '#run', 'i.N' || n || '#run', NULL FROM svc WHERE n NOT IN (SELECT n FROM kept)
UNION ALL SELECT 'b.Base' || n || '#go', 'b.Base' || n || '#go', NULL FROM svc
UNION ALL SELECT 'b.Base' || n || '#go', 'b.Sub' || n || '#go', '运行时可能调用覆写方法' FROM svc WHERE n % 4 = 3""")
def q_dispatch_targets(spark, d):
    """J-3 to J-5, P-10, U-2, S-6, S-9, S-10, J-17: implementations of interface methods, narrowed by name and primary, and overrides of virtual methods beside the method itself."""
    facts = service_facts(spark, d)
    return symbols.dispatch(facts, facts["method"].select("method_key").distinct(), True).select("callee_key", "target_key", "reason")


@query("""SELECT n_nationkey, CASE COUNT(s_suppkey) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN COUNT(s_suppkey) = 1 THEN 'a.S' || MIN(s_suppkey) || '#run' END AS target
FROM nation LEFT JOIN (SELECT *, SUM(CAST(s_suppkey % 7 = 0 AS INT)) OVER (PARTITION BY s_nationkey) AS prims, COUNT(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier WHERE s_suppkey % 11 <> 0) s
ON s_nationkey = n_nationkey AND (c = 1 OR prims <> 1 OR s_suppkey % 7 = 0) GROUP BY n_nationkey""")
def q_exactly_one(spark, d):
    """O-8, P-31, J-10: the root of a batch row behind an interface counts only if it is the only implementation."""
    from ripplegraph.operators import joins

    facts = service_facts(spark, d)
    known = symbols.methods(facts).select("method_key", "is_abstract").filter("method_key like 'i.N%'")
    found = dispatch_roots({**facts}, symbols.methods(facts).select("method_key", "is_abstract"))
    out = known.join(found, "method_key", "left").withColumn("impls", F.coalesce("impls", F.lit(0)))
    return out.select(F.regexp_extract("method_key", r"(\d+)", 1).cast("int").alias("n_nationkey"), joins.status_of(F.col("impls")).alias("status"), F.when(F.col("impls") == 1, F.col("impl")).alias("target"))

"""Extractors: from call contexts to the resources that the code there touches.

A context is a method's own body (no call) or one call in it with its resolved target. Extraction doesn't
depend on how a method is reached, so it runs once over all contexts; the walk adds paths and confidence later.
Each extractor takes a ``Contexts`` and returns ``RESOURCE`` rows; ``EXTRACTORS`` is the list in use, and
an analysis may be given another.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.model import Options
from ripplegraph.operators.symbols import Facts, ancestors, annotated, attribute, concrete, configured, expression_values, methods, urls, value_fields
from ripplegraph.sources import config, mapper
from ripplegraph.storage import dealt, materialize, parts_of

FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
RESOURCE = ["ctx_id", "type", "name", "operation", "conf_rank", "detail", "rule"]
UNKNOWN_URL = "待确认URL"
UNKNOWN_SERVICE = "待确认服务"
# What marks an ORM's own types, the place of the entity among their type arguments, and its calls.
ORM_MARKERS = {"BaseMapper": 0, "IService": 0, "ServiceImpl": 1}
MAPPINGS = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping")
ROCKET_PACKAGES = ("com.aliyun.openservices.ons.api.", "org.apache.rocketmq.")
LISTENER_ATTRIBUTES = ("topics", "topic", "queues", "queue", "value", "name")
# What evidence says beyond the place.
BY_STATEMENT, BY_GENERIC, NO_STATEMENT = "MyBatis ", "MyBatis 通用 Mapper ", "；XML/Provider 未解析出表，按调用点泛型实体推断"
BY_ORM, OF_ENTITY, ORM_NAMED, ENTITY_NAMED, NAMED_BY_RULE = "MyBatis-Plus ", "；实体 ", "；@TableName/@Table", "；实体注解表名", "；按默认命名规则推断"
BY_NATIVE_QUERY, BY_REPOSITORY, BY_CLIENT, BY_HTTP = "JPA native query ", "JPA Repository ", "Feign ", "HTTP client "
DYNAMIC_TABLE, BY_KEYWORD = "；包含动态表名表达式", "；SQL 解析失败，使用后备识别"
FROM_MESSAGE, FROM_WRAPPER, RABBIT_LISTENER = "；从 ONS/RocketMQ Message 构造参数解析", "；从 RocketMQ 包装器参数解析", "Rabbit consumer annotation"


@dataclass
class Contexts:
    """Contexts and what extractors look up about them."""

    facts: Facts
    options: Options
    rows: DataFrame  # ctx_id, project, method_key, call_id, target_key, owner, owner_short, name, text, qualifier_*, method_owner, method_name
    arguments: DataFrame  # ctx_id, values (known argument strings in order), value0, value1, text0
    values: DataFrame  # expr_id, value: the constants behind expressions


def _sized(spark: SparkSession) -> None:
    """Tables of keys and names take many times the room of their files; without this the session would take them for small and broadcast them."""
    if float(spark.conf.get(FILE_FACTOR)) == 1.0:
        spark.conf.set(FILE_FACTOR, "20.0")


def contexts(facts: Facts, options: Options) -> Contexts:
    _sized(facts["method"].sparkSession)
    m = methods(facts)
    own = m.select(
        F.concat(F.lit("m|"), "method_key").alias("ctx_id"), "project", "method_key", F.lit(None).cast("string").alias("call_id"), F.col("method_key").alias("target_key"),
        F.col("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("qualifier_type", "string"), ("qualifier_type_args", "array<string>"), ("qualifier_symbol", "string"))], F.lit(-1).alias("ord"),
    )
    calls = facts["call_site"].filter("kind = 'call' and callee_key is not null").select(
        F.concat(F.lit("c|"), "call_id").alias("ctx_id"), "project", F.col("caller_key").alias("method_key"), "call_id", F.col("callee_key").alias("target_key"),
        "text", "qualifier_type", "qualifier_type_args", "qualifier_symbol", "ord",
    )
    target = m.select(F.col("method_key").alias("target_key"), F.col("class_fqn").alias("owner"), "name", "param_types", "return_type", F.col("is_project_source").alias("target_source"))
    within = m.select("method_key", F.col("class_fqn").alias("method_owner"), F.col("name").alias("method_name"))
    rows = own.unionByName(calls).join(target, "target_key").join(within, "method_key")
    rows = rows.withColumns({"owner": F.coalesce("owner", F.lit("")), "text": F.coalesce("text", F.lit("")), "owner_short": F.element_at(F.split(F.coalesce("owner", F.lit("")), r"\."), -1)})
    rows = materialize(rows, "contexts")
    values = materialize(expression_values(facts), "values")
    parts = parts_of(facts["call_arg"])
    args = dealt(facts["call_arg"].select("call_id", "pos", "expr_id"), parts, "expr_id").join(dealt(values, parts, "expr_id"), "expr_id", "left")
    args = args.join(dealt(facts["expr"].select("expr_id", F.col("text").alias("arg_text")), parts, "expr_id"), "expr_id", "left")
    all_ = dealt(args, parts, "call_id").groupBy("call_id").agg(F.collect_list(F.struct("pos", "value", "arg_text", "expr_id")).alias("a"))  # a call's few arguments
    at = lambda c, p: F.array_max(F.transform(F.filter("a", lambda x: x["pos"] == p), lambda x: x[c]))
    known = F.transform(F.array_sort(F.transform(F.filter("a", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x["value"].alias("value")))), lambda x: x["value"])
    by_call = all_.select("call_id", known.alias("values"), at("value", 0).alias("value0"), at("value", 1).alias("value1"), at("arg_text", 0).alias("text0"), at("expr_id", 0).alias("expr0"))
    arguments = by_call.select(F.concat(F.lit("c|"), "call_id").alias("ctx_id"), "values", "value0", "value1", "text0", "expr0")
    return Contexts(facts, options, rows, materialize(arguments, "arguments"), values)


def _out(rows: DataFrame, kind: str, name: Column, operation: Column | str, conf: Column | int, detail: Column, rule: str) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("ctx_id", F.lit(kind).alias("type"), name.alias("name"), lit(operation).alias("operation"), lit(conf).cast("int").alias("conf_rank"), detail.alias("detail"), F.lit(rule).alias("rule")).filter("name is not null")


def _call_name() -> Column:
    return F.concat_ws(".", "owner", "name")


def _union(found: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def sql_resources(rows: DataFrame, sql: str, detail: Column, rule: str) -> DataFrame:
    """Tables of statements: certain if read whole, dynamic ones open, those found by keyword inferred."""
    # each different statement is read once
    distinct = rows.select(F.col(sql).alias("_sql")).filter("_sql is not null").distinct()
    read = distinct.withColumn("_t", mapper.statement_tables(text.clean_statement(F.col("_sql"))))
    joined = rows.join(read, F.col(sql) == F.col("_sql")).withColumn("_table", F.explode("_t.tables"))
    conf = F.when(~F.col("_t.parsed"), 1).when(text.is_dynamic(F.col(sql)), 2).otherwise(0)
    detail = F.concat(detail, F.when(~F.col("_t.parsed"), BY_KEYWORD).when(text.is_dynamic(F.col(sql)), DYNAMIC_TABLE).otherwise(""))
    return _out(joined, "MYSQL", F.col("_table"), text.statement_operation(F.regexp_replace(sql, "<[^>]+>", " ")), conf, detail, rule)


def entity_names(facts: Facts) -> DataFrame:
    """(class_fqn, table, explicit) of every class."""
    out = facts["src_class"].select("class_fqn", "short_name").dropDuplicates(["class_fqn"])
    for short, attr, alias in (("TableName", "value", "t0"), ("Table", "name", "t1"), ("Entity", "name", "t2")):
        out = out.join(annotated(facts, "class", short, attribute(attr), alias).withColumnRenamed("target_id", "class_fqn"), "class_fqn", "left")
    t = text.entity_table(F.col("t0"), F.col("t1"), F.col("t2"), F.col("short_name"))
    return out.select("class_fqn", t.alias("t")).select("class_fqn", F.col("t.name").alias("table"), F.col("t.explicit").alias("explicit"))


def _marked(c: Contexts, start: Column, args: Column, markers: Column) -> DataFrame:
    """(ctx_id, entity): the entity type argument of the nearest marker type that a context's type is or extends."""
    starts = c.rows.select("ctx_id", start.alias("class_fqn"), args.alias("args"), "method_owner").filter("class_fqn is not null")
    starts = concrete(c.facts, starts, ["args"], "method_owner")
    keyed = starts.withColumn("start", F.concat_ws("|", "class_fqn", F.array_join(F.coalesce("args", F.array().cast("array<string>")), ",", "?")))
    up = ancestors(c.facts, keyed.select("start", "class_fqn", "args"))
    found = up.withColumn("index", markers).filter("index is not null").select("start", "class_fqn", "depth", F.try_element_at("args", (F.col("index") + 1).cast("int")).alias("entity"))
    found = concrete(c.facts, found, ["entity"], "class_fqn")
    best = found.filter("entity is not null").groupBy("start").agg(F.min(F.struct("depth", "entity")).alias("b")).select("start", F.col("b.entity").alias("entity"))
    return keyed.join(best, "start").select("ctx_id", "entity")


def _orm_index() -> Column:
    short = F.element_at(F.split("class_fqn", r"\."), -1)
    return reduce(lambda w, kv: w.when(short == kv[0], kv[1]), list(ORM_MARKERS.items())[1:], F.when(short == "BaseMapper", 0))


def mybatis(c: Contexts) -> DataFrame:
    """X-1: statements of mapper files for mapper methods; generated mapper methods by entity."""
    marked = annotated(c.facts, "class", "Mapper", F.lit("y"), "_m").withColumnRenamed("target_id", "owner")
    rows = c.rows.join(marked, "owner", "left").filter(F.col("owner").endswith("Mapper") | F.col("_m").isNotNull() | F.col("owner").startswith("tk.mybatis.mapper."))
    s = mapper.statements(c.facts["mapper_file"]).select(F.col("namespace").alias("owner"), F.col("id").alias("name"), "sql").distinct()
    stated = rows.join(s, ["owner", "name"])
    by_file = sql_resources(stated, "sql", F.concat(F.lit(BY_STATEMENT), "owner", F.lit("#"), "name"), "mapper")
    generated = F.col("owner").startswith("tk.mybatis.mapper.") | F.contains(F.col("name"), F.lit("ByExample")) | F.col("name").isin("selectByPrimaryKey", "insertSelective")
    open_ = rows.filter(generated).join(by_file.select("ctx_id").distinct(), "ctx_id", "left_anti")
    inner = _marked(c, F.coalesce("qualifier_type", "method_owner"), F.col("qualifier_type_args"), F.when(F.col("class_fqn").startswith("tk.mybatis.mapper."), 0))
    param = F.filter(F.coalesce("param_types", F.array().cast("array<string>")), lambda p: ~p.endswith("Example") & F.contains(p, F.lit(".")) & ~p.startswith("java."))
    open_ = open_.join(inner, "ctx_id", "left").withColumn("class_fqn", F.coalesce("entity", F.try_element_at(param, F.lit(1))))
    open_ = open_.join(entity_names(c.facts), "class_fqn", "left")
    name = F.coalesce("table", F.when(F.col("target_source"), text.table_from_class(F.col("owner_short"))))
    return by_file.unionByName(_out(open_, "MYSQL", name, text.generic_mapper_operation(F.col("name")), 1, F.concat(F.lit(BY_GENERIC), "owner", F.lit("#"), "name", F.lit(NO_STATEMENT)), "generated mapper"))


def mybatis_plus(c: Contexts) -> DataFrame:
    """X-2: the ORM's own calls on mappers and services, by entity."""
    op = text.orm_operation(F.col("name"))
    up = ancestors(c.facts, c.rows.select(F.explode(F.array("owner", "qualifier_type")).alias("class_fqn")).filter("class_fqn is not null").distinct().select(F.col("class_fqn").alias("start"), "class_fqn", F.lit(None).cast("array<string>").alias("args")))
    orm = up.filter(F.element_at(F.split("class_fqn", r"\."), -1).isin(*ORM_MARKERS, "Db")).select("start").distinct()
    gate = c.rows.filter(op.isNotNull() & F.col("call_id").isNotNull())
    gate = gate.join(orm.withColumnRenamed("start", "owner").withColumn("_a", F.lit(True)), "owner", "left").join(orm.withColumnRenamed("start", "qualifier_type").withColumn("_b", F.lit(True)), "qualifier_type", "left").filter("_a or _b")
    args = c.facts["call_arg"].join(c.facts["expr"].select("expr_id", "kind", F.col("ref_symbol").alias("class_of")), "expr_id", "left")
    wrapper = F.coalesce(F.col("type_fqn").rlike("Wrapper"), F.lit(False))
    args = args.withColumns({"_wrapped": F.when(wrapper, F.try_element_at("type_args", F.lit(1))), "_plain": F.when(~wrapper, F.col("type_fqn"))})
    args = args.withColumn("ctx_id", F.concat(F.lit("c|"), "call_id")).join(gate.select("ctx_id", "method_owner"), "ctx_id")
    args = concrete(c.facts, args, ["_wrapped", "_plain"], "method_owner")
    literal = F.when(F.col("kind") == "class_literal", F.coalesce("class_of", F.try_element_at("type_args", F.lit(1))))
    given = F.coalesce(literal, "_wrapped")
    by_arg = args.groupBy("ctx_id").agg(
        F.min_by(given, F.when(given.isNotNull(), F.col("pos"))).alias("e0"),
        F.min_by("_plain", F.when(F.col("_plain").isNotNull(), F.col("pos"))).alias("e3"),
    )
    q = _marked(c, F.col("qualifier_type"), F.col("qualifier_type_args"), _orm_index()).withColumnRenamed("entity", "e1")
    t = _marked(c, F.col("owner"), F.lit(None).cast("array<string>"), _orm_index()).withColumnRenamed("entity", "e2")
    rows = gate.join(by_arg, "ctx_id", "left").join(q, "ctx_id", "left").join(t, "ctx_id", "left").withColumn("class_fqn", F.coalesce("e0", "e1", "e2", "e3"))
    rows = rows.join(entity_names(c.facts), "class_fqn")
    named = F.when(F.col("explicit"), ORM_NAMED).otherwise(NAMED_BY_RULE)
    detail = F.concat(F.lit(BY_ORM), _call_name(), F.lit(OF_ENTITY), "class_fqn", named)
    return _out(rows, "MYSQL", F.col("table"), op, F.when(F.col("explicit"), 0).otherwise(1), detail, "orm")


def jpa(c: Contexts) -> DataFrame:
    """X-3: native queries, and repositories by entity."""
    q = annotated(c.facts, "method", "Query", F.when(attribute("nativeQuery") == "true", attribute("value")), "sql").withColumnRenamed("target_id", "target_key")
    native = c.rows.join(q, "target_key").filter("sql is not null")
    by_sql = sql_resources(native, "sql", F.concat(F.lit(BY_NATIVE_QUERY), _call_name()), "query")
    repo = F.coalesce(F.when(F.col("qualifier_type").rlike("Repository$"), F.col("qualifier_type")), F.when(F.col("owner").rlike("Repository$"), F.col("owner")))
    rows = c.rows.withColumn("repo", repo).filter("repo is not null").join(native.select("ctx_id"), "ctx_id", "left_anti")
    marker = F.when(F.col("class_fqn").rlike("Repository$"), 0)
    inner = _marked(c, repo, F.col("qualifier_type_args"), F.when(F.size("args") > 0, marker))
    entities = c.facts["annotation"].filter("target_kind = 'class' and (short_name = 'Entity' or fqn like '%.Entity')").select(F.col("target_id").alias("class_fqn")).distinct()
    near = rows.select("ctx_id", F.posexplode(F.concat(F.coalesce("param_types", F.array().cast("array<string>")), F.array("return_type"))).alias("pos", "class_fqn")).join(entities, "class_fqn", "left_semi")
    near = near.groupBy("ctx_id").agg(F.min_by("class_fqn", "pos").alias("typed"))
    rows = rows.join(inner, "ctx_id", "left").join(near, "ctx_id", "left").withColumn("class_fqn", F.coalesce("entity", "typed")).join(entity_names(c.facts), "class_fqn")
    conf = F.when(F.col("explicit"), 0).otherwise(1)
    detail = F.concat(F.lit(BY_REPOSITORY), "repo", F.lit("."), "name", F.when(F.col("explicit"), ENTITY_NAMED).otherwise(NAMED_BY_RULE))
    return by_sql.unionByName(_out(rows, "MYSQL", F.col("table"), text.repository_operation(F.col("name")), conf, detail, "repository"))


def infrastructure(c: Contexts) -> DataFrame:
    """X-4: caches, queues and topics. The call rules are exclusive, in order: the first that holds is the only one tried."""
    f, o = c.facts, c.options
    rows = c.rows.join(c.arguments, "ctx_id", "left")
    producer = f["annotation"].filter((F.col("target_kind") == "field") & configured(o.producer_annotations, F.col("fqn"), F.col("short_name")))
    producer = producer.groupBy(F.col("target_id").alias("qualifier_symbol")).agg(F.min_by(attribute("queue", "value", "name"), "ord").alias("producer_queue"), F.min_by("short_name", "ord").alias("producer_note"))
    fields = f["variable"].select(F.col("symbol").alias("qualifier_symbol"), F.col("name").alias("producer_field")).dropDuplicates(["qualifier_symbol"])
    rows = rows.join(producer.join(fields, "qualifier_symbol", "left"), "qualifier_symbol", "left")
    topics = f["variable"].filter("kind = 'field'").join(value_fields(f), "symbol").filter(F.lower("name").contains("topic"))
    topics = topics.groupBy(F.col("owner_fqn").alias("owner")).agg(F.min_by("placeholder", "ord").alias("topic_field"))
    rows = rows.join(topics, "owner", "left")
    message = f["expr"].select(F.col("expr_id").alias("expr0"), "kind", "ref_symbol", "operands")
    held = f["variable"].select(F.col("symbol").alias("ref_symbol"), F.col("init_expr_id").alias("init0")).dropDuplicates(["ref_symbol"])
    made = f["expr"].filter("kind = 'new'").select(F.col("expr_id").alias("new_id"), F.col("operands").alias("new_args"), F.col("ref_symbol").alias("new_class"), F.col("text").alias("new_text"))
    message = message.join(held, "ref_symbol", "left").withColumn("new_id", F.when(F.col("kind") == "new", F.col("expr0")).otherwise(F.col("init0"))).join(made, "new_id")
    message = message.filter(F.contains(F.coalesce("new_class", "new_text"), F.lit("Message")))
    values, texts = c.values, f["expr"].select("expr_id", "text")
    for i in range(2):
        v = values.select(F.col("expr_id").alias(f"_e{i}"), F.col("value").alias(f"m{i}"))
        message = message.withColumn(f"_e{i}", F.try_element_at("new_args", F.lit(i + 1))).join(v, f"_e{i}", "left")
    message = message.join(texts.select(F.col("expr_id").alias("_e0"), F.col("text").alias("mtext")), "_e0", "left").select("expr0", "m0", "m1", "mtext")
    rows = materialize(rows.join(message, "expr0", "left"), "infra")
    owner, name = F.col("owner"), F.col("name")
    package = owner.startswith(ROCKET_PACKAGES[0]) | owner.startswith(ROCKET_PACKAGES[1])
    rule = (
        F.when(name.isin("send", "sendAsync", "sendOneway", "sendOneWay") & package, "ons")
        .when((name == "subscribe") & package, "subscribe")
        .when(name.isin("sendMsg", "sendDelayMsg", "sendMessage", "sendDelayMessage") & configured(o.producer_classes, owner, F.col("owner_short")), "wrapper")
        .when(F.contains(owner, F.lit("RocketMQ")), "template")
        .when(F.contains(owner, F.lit("Kafka")) | ((name == "send") & F.contains(F.col("text"), F.lit("Kafka"))), "kafka")
        .when(F.col("producer_queue").isNotNull(), "producer")
        .when(F.contains(owner, F.lit("Rabbit")) | (name.isin("convertAndSend", "send") & F.contains(F.col("text"), F.lit("Rabbit"))), "rabbit")
    )
    ruled = rows.withColumn("_rule", rule)
    of = lambda r: ruled.filter(F.col("_rule") == r)
    dynamic = lambda t: F.concat(F.lit(f"{text.DYNAMIC_DESTINATION} "), t)
    sent = F.coalesce(text.destination(F.col("m0"), F.col("m1")), dynamic(F.col("mtext")))
    plain = F.coalesce(text.destination(F.col("value0"), F.col("value1")), dynamic(F.col("text0")))
    first = F.coalesce(F.col("value0"), dynamic(F.col("text0")))
    kafka_call = F.when(F.contains(owner, F.lit("KafkaTemplate")) | F.contains(F.lower("value0"), F.lit("topic")), F.col("value0"))
    kafka = F.coalesce(kafka_call, "topic_field")
    arg = lambda i: F.try_element_at("values", F.lit(i))
    rabbit = F.when((name == "convertAndSend") & (F.size("values") >= 2), F.concat(arg(1), F.lit(" -> "), arg(2))).otherwise(arg(1))
    redis = rows.filter(F.contains(owner, F.lit("Redis")) | F.contains(F.col("text"), F.lit("RedisTemplate")))
    found = [
        _out(redis, "REDIS", F.coalesce(arg(1), "text0"), text.redis_operation(name), F.when(F.size(F.coalesce("values", F.array().cast("array<string>"))) > 0, 1).otherwise(2), _call_name(), "redis"),
        _out(of("ons"), "ROCKETMQ", sent, "PRODUCE", text.confidence_of_destination(sent), F.concat(_call_name(), F.lit(FROM_MESSAGE)), "ons"),
        _out(of("subscribe"), "ROCKETMQ", plain, "CONSUME", text.confidence_of_destination(plain), _call_name(), "subscribe"),
        _out(of("wrapper"), "ROCKETMQ", plain, "PRODUCE", text.confidence_of_destination(plain), F.concat(_call_name(), F.lit(FROM_WRAPPER)), "wrapper"),
        _out(of("template"), "ROCKETMQ", first, "PRODUCE", F.when(F.col("value0").isNull(), 2).otherwise(0), _call_name(), "template"),
        _out(of("kafka"), "KAFKA", kafka, "PRODUCE", F.when(kafka.startswith("${"), 0).otherwise(1), _call_name(), "kafka"),
        _out(of("producer"), "RABBITMQ", F.col("producer_queue"), "PRODUCE", 0, F.concat(F.lit("@"), "producer_note", F.lit(" "), F.coalesce("producer_field", F.lit(""))), "producer"),
        _out(of("rabbit"), "RABBITMQ", rabbit, "PRODUCE", 1, _call_name(), "rabbit"),
    ]
    slim = rows.select("ctx_id", "method_key", "method_owner", "method_name")
    for short in ("Cacheable", "CachePut", "CacheEvict"):
        a = annotated(f, "method", short, attribute("cacheNames", "value"), "v").withColumnRenamed("target_id", "method_key")
        found.append(_out(slim.join(a, "method_key"), "REDIS", F.col("v"), "UNKNOWN", 0, F.lit("Spring Cache 注解"), "cache"))
    for short, kind, said in (("KafkaListener", "KAFKA", "@KafkaListener"), ("RabbitListener", "RABBITMQ", RABBIT_LISTENER)):
        a = annotated(f, "method", short, attribute(*LISTENER_ATTRIBUTES), "v").withColumnRenamed("target_id", "method_key")
        found.append(_out(slim.join(a, "method_key"), kind, F.col("v"), "CONSUME", 0, F.lit(said), "listener"))
    found.append(_listeners(c, slim))
    return _union(found)


def _listeners(c: Contexts, slim: DataFrame) -> DataFrame:
    """Configured consumer annotations, class or method; message listeners; listener interfaces by their topic() and tag()."""
    f, o = c.facts, c.options
    a = f["annotation"].filter(configured(o.consumer_annotations, F.col("fqn"), F.col("short_name")))
    a = a.groupBy("target_kind", "target_id").agg(F.min_by(attribute(*LISTENER_ATTRIBUTES), "ord").alias("v"))
    on_method = a.filter("target_kind = 'method'").select(F.col("target_id").alias("method_key"), F.col("v").alias("v0"))
    on_class = a.filter("target_kind = 'class'").select(F.col("target_id").alias("method_owner"), F.col("v").alias("v1"))
    both = slim.join(on_method, "method_key", "left").join(on_class, "method_owner", "left")
    found = [_out(both, "RABBITMQ", F.coalesce("v0", "v1"), "CONSUME", 0, F.lit("自定义 MQ 消费者注解"), "consumer")]
    listener = F.when(attribute("topic").isNotNull(), text.destination(attribute("topic"), attribute("selectorExpression")))
    m = annotated(f, "method", "RocketMQMessageListener", listener, "v0").withColumnRenamed("target_id", "method_key")
    k = annotated(f, "class", "RocketMQMessageListener", listener, "v1").withColumnRenamed("target_id", "method_owner")
    both = slim.join(m, "method_key", "left").join(k, "method_owner", "left")
    at = F.coalesce("v0", F.when(F.col("method_name") == "onMessage", F.col("v1")))
    found.append(_out(both, "ROCKETMQ", at, "CONSUME", 0, F.lit("@RocketMQMessageListener"), "listener"))
    faces = f["supertype"].filter(configured(o.consumer_interfaces, F.col("super_fqn"), F.element_at(F.split("super_fqn", r"\."), -1))).select(F.col("class_fqn").alias("method_owner")).distinct()
    literal = text.blank_to_null(F.regexp_extract("text", r'return\s[^;]*?"([^"]*)"', 1))
    returned = F.regexp_extract("text", r"return\s+(?:\w+\s*\.\s*)*(\w+)\s*;", 1)
    fields = f["variable"].filter("kind = 'field'").join(c.values.withColumnRenamed("expr_id", "init_expr_id"), "init_expr_id")
    constants = fields.groupBy(F.col("owner_fqn").alias("method_owner"), F.col("name").alias("_field")).agg(F.min_by("value", "ord").alias("constant"))
    told = f["method"].filter("size(param_types) = 0 and name in ('topic', 'tag')").select(F.col("class_fqn").alias("method_owner"), "name", "ord", literal.alias("literal"), returned.alias("_field"))
    told = told.join(constants, ["method_owner", "_field"], "left").withColumn("v", F.coalesce("constant", "literal"))
    said = told.groupBy("method_owner").agg(*[F.min_by(F.when(F.col("name") == n, F.col("v")), F.when(F.col("name") == n, F.col("ord"))).alias(n) for n in ("topic", "tag")])
    rows = slim.filter("method_name = 'consume'").join(faces, "method_owner", "left_semi").join(said, "method_owner")
    where = text.destination(F.col("topic"), F.when(~F.col("tag").eqNullSafe(F.col("topic")), F.col("tag")))
    found.append(_out(rows, "ROCKETMQ", where, "CONSUME", 1, F.lit("自定义 MQ 消费者接口 topic()/tag()"), "interface"))
    return _union(found)


def feign_endpoints(facts: Facts) -> DataFrame:
    """(target_key, service, service_key, verb, path, display_path, source) of declared HTTP client methods."""
    a = facts["annotation"].filter((F.col("target_kind") == "class") & F.col("short_name").endswith("FeignClient"))
    get = lambda *names: F.coalesce(*[text.blank_to_null(F.try_element_at(F.try_element_at("declared_attrs", F.lit(n)), F.lit(1))) for n in names])
    service = F.when(F.col("short_name") == "FeignClient", get("name", "value", "url")).otherwise(get("url", "name", "value"))
    client = a.groupBy(F.col("target_id").alias("class_fqn")).agg(F.min_by(F.struct(F.coalesce(service, F.lit(UNKNOWN_SERVICE)).alias("service"), attribute("path").alias("base"), F.col("short_name").alias("client")), "ord").alias("c"))
    mappings = endpoint_mappings(facts, ("path", "value")).withColumnRenamed("method_key", "target_key")
    m = facts["method"].select(F.col("method_key").alias("target_key"), "class_fqn", "name").join(client, "class_fqn").join(mappings, "target_key")
    rest = F.when(F.contains(F.col("c.service"), F.lit("/")), F.regexp_replace(F.regexp_replace("c.service", "^[^/]*/", ""), "^/+|/+$", ""))
    return m.select(
        "target_key", F.col("c.service").alias("service"), F.trim(F.substring_index("c.service", "/", 1)).alias("service_key"), "verb",
        text.normalize_path(rest, F.col("c.base"), F.col("class_path"), F.col("method_path")).alias("path"),
        text.normalize_path(F.col("c.base"), F.col("class_path"), F.col("method_path")).alias("display_path"),
        F.concat(F.col("c.client"), F.lit(" "), F.concat_ws(".", "class_fqn", "name")).alias("source"),
    )


def endpoint_mappings(facts: Facts, attributes: tuple[str, str] = ("value", "path")) -> DataFrame:
    """(method_key, verb, class_path, method_path) of methods with a mapping annotation; the first in their order decides.

    The path is the first of these ``attributes`` that is there; declared clients ask in the other order.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in MAPPINGS]), F.element_at(F.split(F.coalesce("short_name", "fqn"), r"\."), -1))
    a = facts["annotation"].filter("target_kind = 'method'").withColumn("_o", order).filter("_o > 0")
    all_text = F.concat_ws(" ", F.map_values(F.coalesce("attr_text", F.create_map().cast("map<string,string>"))))
    pick = F.struct(attribute(*attributes).alias("method_path"), text.mapping_verb(F.col("short_name"), all_text).alias("verb"))
    best = a.groupBy(F.col("target_id").alias("method_key")).agg(F.min_by(pick, F.struct("_o", "ord")).alias("m"))
    of_class = annotated(facts, "class", "RequestMapping", attribute(*attributes), "class_path").withColumnRenamed("target_id", "class_fqn")
    owners = facts["method"].select("method_key", "class_fqn").dropDuplicates(["method_key"])
    return best.join(owners, "method_key").join(of_class, "class_fqn", "left").select("method_key", F.col("m.verb").alias("verb"), "class_path", F.col("m.method_path").alias("method_path"))


def external_http(c: Contexts) -> DataFrame:
    """X-5: declared clients, then client classes by verb and address; placeholders from the project's configuration."""
    known = config.expanded(config.key_values(c.facts["config_file"]))
    f = c.rows.join(feign_endpoints(c.facts), "target_key")
    raw = F.concat_ws(" ", "service", "verb", "display_path")
    f = f.withColumn("raw", raw).withColumn("_conf", F.when(F.col("service").startswith("${") | (F.col("display_path") == "/"), 2).otherwise(0))
    f = config.resolve(f, known, "raw", "shown")
    note = lambda d: F.when(F.col("raw") == F.col("shown"), d).otherwise(F.concat(d, F.lit("；配置解析："), "raw", F.lit(" -> "), "shown"))
    by_feign = _out(f, "EXTERNAL_HTTP", F.col("shown"), "CALL", F.col("_conf"), note(F.concat(F.lit(BY_CLIENT), "source")), "feign")
    owner = F.col("owner")
    client = F.contains(owner, F.lit("RestTemplate")) | F.contains(owner, F.lit("WebClient")) | F.contains(owner, F.lit("OkHttp")) | text.starts_with_any(owner, list(c.options.http_client_prefixes))
    h = c.rows.filter(client & F.col("call_id").isNotNull()).join(f.select("ctx_id"), "ctx_id", "left_anti").join(c.arguments, "ctx_id", "left")
    h = h.join(urls(c.facts).select(F.col("expr_id").alias("expr0"), F.col("value").alias("url")), "expr0", "left")
    h = config.resolve(h.withColumn("raw", F.coalesce("url", F.lit(UNKNOWN_URL))), known, "raw", "shown")
    conf = F.when(F.col("url").isNull(), 2).otherwise(1)
    name = F.concat_ws(" ", text.http_verb(F.col("name")), "shown")
    return by_feign.unionByName(_out(h, "EXTERNAL_HTTP", name, "CALL", conf, note(F.concat(F.lit(BY_HTTP), _call_name())), "client"))


EXTRACTORS: list[Callable[[Contexts], DataFrame]] = [mybatis, mybatis_plus, jpa, infrastructure, external_http]


def run(extractors: list[Callable[[Contexts], DataFrame]], c: Contexts) -> tuple[DataFrame, list[str]]:
    """(resources, warnings): each extractor over the contexts that it ``supports`` (an attribute, a condition; all if it has none).

    Each is a job of its own, side by side with the others, so one that fails costs its own resources and leaves a warning.
    """
    spark = c.rows.sparkSession
    none = spark.createDataFrame([], "ctx_id string, type string, name string, operation string, conf_rank int, detail string, rule string")

    def one(extractor: Callable[[Contexts], DataFrame]) -> DataFrame | str:
        gate = getattr(extractor, "supports", None)
        name = getattr(extractor, "__name__", type(extractor).__name__)
        try:
            given = c if gate is None else replace(c, rows=c.rows.filter(gate))
            return materialize(extractor(given).select(*RESOURCE).distinct(), "extracted")
        except Exception as error:  # whatever an extractor raises concerns it alone
            return f"{name} 解析失败：{str(error).splitlines()[0] if str(error) else type(error).__name__}"

    with ThreadPoolExecutor(max(len(extractors), 1)) as pool:
        done = [pool.submit(copy_context().run, inheritable_thread_target(one), e) for e in extractors]
        found = [d.result() for d in done]
    return _union([none, *[x for x in found if not isinstance(x, str)]]), [x for x in found if isinstance(x, str)]

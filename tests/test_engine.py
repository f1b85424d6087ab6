import io
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ripplegraph.model import Options
from ripplegraph.operators import reports
from ripplegraph.plans.engine import Engine
from tests.fixture import build


@pytest.fixture(scope="module")
def run(spark):
    engine = Engine(build(spark), Options(excluded_prefixes=("java.",), merge_resources=True))
    inputs = spark.createDataFrame([("/api/order/save",)], "value string")
    result = engine.analyze(engine.by_path(inputs))
    return engine, result


@pytest.fixture
def engine(run):
    """The engine of the module, its options put back after each test."""
    held = run[0].options
    yield run[0]
    run[0].options = held


def found(result):
    return {(r["type"], r["name"], r["operation"]): r["conf_rank"] for r in result.resources.collect()}


def test_resources(run):
    got = found(run[1])
    assert got[("MYSQL", "order_log", "WRITE")] == 1  # certain by itself, but behind one of several implementations
    assert got[("MYSQL", "t_order", "READ")] == 1
    assert got[("REDIS", "order:1", "READ")] == 1
    assert got[("KAFKA", "${mq.order.topic}", "PRODUCE")] == 1
    assert got[("KAFKA", "${mq.order.topic}", "CONSUME")] == 1
    assert got[("REDIS", "orders", "UNKNOWN")] == 1
    assert got[("EXTERNAL_HTTP", "POST http://pay.local/pay", "CALL")] == 1
    assert got[("EXTERNAL_HTTP", "bill-svc GET /bill/get-one", "CALL")] == 1
    assert not any("mq.other" in name for _, name, _ in got)


def test_graph(run):
    engine, result = run
    edges = {(r["caller"], r["callee"]): (r["conf_rank"], r["reason"]) for r in result.edges.collect()}
    assert edges[("a.OrderController#save", "a.OrderService#save")] == (0, "PSI resolve")
    assert edges[("a.OrderService#save", "a.OrderServiceImpl#save")] == (1, "唯一实现类")
    assert ("a.OrderService#save", "a.OtherServiceImpl#save") not in edges  # narrowed by the injected name
    assert edges[("a.OrderController#save", "a.Consumer#onOrder")] == (1, "本地 MQ 消费者：${mq.order.topic}")
    assert not any("java.util" in b or "getId" in b for _, b in edges)
    warnings = {r["message"] for r in result.warnings.collect()}
    assert warnings == {"无法解析调用：mystery()"}


def test_evidence(run):
    detail = {r["name"]: r["detail"] for r in run[1].resources.collect()}
    assert "a.OrderController.save -> a.OrderServiceImpl.save [推断分支] -> a.OrderMapper.insertOrder" in detail["order_log"]


def test_reports(run):
    _, result = run
    lines = [r["line"] for r in reports.detail_csv(result).collect()]
    assert any(line.startswith('"HTTP","POST /api/order/save","MySQL","order_log","写入"') for line in lines)
    chart = [r["line"] for r in reports.mermaid(result).collect()]
    assert any("-->|推断|" in x for x in chart) and any("-.->" in x for x in chart)
    row = reports.overview(result).collect()[0]["line"]
    assert "写入：`order_log`<br>只读：`t_order`" in row and row.count(" | ") == 11


def test_hop_to_another_project(spark, engine):
    options = replace(engine.options, follow_cross_project=True, service_mappings={"bill-svc": "bill"})
    result = engine.analyze(engine.by_topic(spark.createDataFrame([("${mq.order.topic}",)], "value string")), options)
    edges = {(r["caller"], r["callee"]): r["reason"] for r in result.edges.collect()}
    assert edges[("a.Http#call", "b.BillController#one")] == "跨工程 Feign：shop -> bill"


def test_options(spark, engine):
    engine.options = replace(engine.options, max_depth=1, follow_local_consumers=False, merge_resources=False, query_patterns=("/get-",))
    result = engine.analyze(engine.by_method(spark.createDataFrame([("a.Http#call",)], "value string")))
    got = found(result)
    assert got[("EXTERNAL_HTTP", "bill-svc GET /bill/get-one", "READ")] == 0
    assert not any(k == "MYSQL" for k, _, _ in got)  # beyond the limit
    assert any(r["message"].startswith("调用链达到最大深度 1") for r in result.warnings.collect())


def test_batch(spark, engine):
    inputs = spark.createDataFrame([(1, "/api/order/save"), (2, "/api/order/list"), (3, "/none"), (4, "x")], "idx int, value string")
    rows, result = engine.batch(inputs)
    got = {r["idx"]: (r["status"], r["reason"]) for r in rows.collect()}
    assert got == {1: ("SUCCESS", None), 2: ("SKIPPED", "定位到多个接口"), 3: ("SKIPPED", "未定位到接口"), 4: ("SKIPPED", "不是 HTTP 路径")}
    lines = [r["line"] for r in reports.batch_csv(rows, result).collect()]
    assert sum(x.startswith('"3",') for x in lines) == 1 and sum(x.startswith('"1",') for x in lines) > 3
    text = reports.batch_markdown(rows, result)
    assert "- 成功：1" in text and "跳过与失败明细" in text and "消费：`${mq.order.topic}`" in text
    book = zipfile.ZipFile(io.BytesIO(reports.batch_workbook(rows, result)))
    assert "资源汇总" in book.read("xl/workbook.xml").decode() and len(book.namelist()) == 7


def test_hop_warnings(spark, engine):
    asked = engine.by_method(spark.createDataFrame([("a.Http#call",)], "value string"))
    for mapping, end in (({}, "未配置服务映射"), ({"bill-svc": "none"}, "目标工程未打开（映射：none）"), ({"bill-svc": "/p/shop"}, "目标工程与当前工程相同")):
        engine.options = replace(engine.options, follow_cross_project=True, follow_local_consumers=False, max_depth=1, service_mappings=mapping)
        said = [r["message"] for r in engine.analyze(asked).warnings.collect() if r["message"].startswith("Feign")]
        assert said == [f"Feign bill-svc GET /bill/get-one 未续链：{end}"]


def test_entries(spark, engine):
    assert [r["method_key"] for r in engine.by_input(" /api/order/save ").collect()] == ["a.OrderController#save"]
    assert [r["method_key"] for r in engine.by_input("${mq.order.topic}").collect()] == ["a.Consumer#onOrder"]
    asked = spark.createDataFrame([("/none",), ("/api/order/save",)], "value string")
    assert [r["message"] for r in engine.missing(asked, engine.by_path(asked)).collect()] == ["未找到入口：/none"]
    mentioned = spark.createDataFrame([("save(){:tag",), ("nowhere",)], "value string")
    assert [r["method_key"] for r in engine.by_topic(mentioned).collect()] == ["a.OrderController#save"]
    assert engine.by_topic(mentioned, mentions=False).count() == 0
    points = spark.createDataFrame([("p1", "A.java", 12), ("p2", "A.java", 99)], "value string, path string, at int")
    assert [(r["root_id"], r["method_key"]) for r in engine.by_position(points).collect()] == [("p1", "a.Http#call")]


def test_written_lines(run, tmp_path):
    out = str(tmp_path / "lines")
    reports.write_lines(reports.detail_csv(run[1]), out, ["ord"], [reports.header(reports.DETAIL)])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))).splitlines()
    assert lines[0].startswith("\ufeff") and len([x for x in lines if x.startswith('"HTTP"')]) == run[1].resources.count()
    assert reports.sibling("/x/a.csv", "md") == "/x/a.md" and reports.sibling("a.CSV", "csv") == "a.CSV"
    cells = reports.operation_groups(run[1].resources, "KAFKA").collect()
    assert set(cells[0]["cell"].split("\n")) == {"生产：${mq.order.topic}", "消费：${mq.order.topic}"}


def test_a_failing_extractor_leaves_a_warning_and_the_others(spark):
    def broken(c):
        return c.rows.select("no_such_column")

    def late(c):
        from pyspark.sql import functions as F

        rows = c.rows.select("ctx_id", *[F.lit("x").alias(n) for n in ("type", "name", "operation", "detail", "rule")])
        return rows.withColumn("conf_rank", F.raise_error(F.lit("no luck")).cast("int"))

    def gated(c):
        from pyspark.sql import functions as F

        return c.rows.select("ctx_id", F.lit("REDIS").alias("type"), F.col("name"), F.lit("READ").alias("operation"), F.lit(0).alias("conf_rank"), F.lit("d").alias("detail"), F.lit("own").alias("rule"))

    gated.supports = "name = 'getKey'"
    engine = Engine(build(spark), Options(), [broken, late, gated])
    assert len(engine.failures) == 2 and engine.failures[0].startswith("broken 解析失败：") and "no luck" in engine.failures[1]
    result = engine.analyze(engine.by_method(spark.createDataFrame([("a.OrderServiceImpl#save",)], "value string")))
    assert {r["message"] for r in result.warnings.collect()} >= set(engine.failures)
    got = [(r["type"], r["name"]) for r in result.resources.filter("name in ('getKey', 'order_log')").collect()]
    assert sorted(got) == [("MYSQL", "order_log"), ("REDIS", "getKey")]


def test_rows_of_a_batch_fail_by_themselves(spark, engine, monkeypatch):
    inputs = spark.createDataFrame([(1, "/api/order/save"), (2, "/bill/get-one"), (3, "/none")], "idx int, value string")
    some, steps = Engine.analyze, []

    def analyze(self, entries, options=None):
        if entries.filter("method_key = 'b.BillController#one'").count():
            raise RuntimeError("broken row\nmore")
        return some(self, entries, options)

    monkeypatch.setattr(Engine, "analyze", analyze)
    rows, result = engine.batch(inputs, progress=lambda *x: steps.append(x), chunk=1)
    got = {r["idx"]: (r["status"], r["reason"], r["method_key"]) for r in rows.collect()}
    assert got == {1: ("SUCCESS", None, "a.OrderController#save"), 2: ("FAILED", "broken row", None), 3: ("SKIPPED", "未定位到接口", None)}
    assert {r["root_id"] for r in result.resources.collect()} == {"/api/order/save"}
    assert [s[0] for s in steps] == [0, 1, 2, 3]
    assert "- 失败：1" in reports.batch_markdown(rows, result)
    whole, _ = engine.batch(inputs)  # one job, which fails, then its halves
    assert {r["idx"]: (r["status"], r["reason"], r["method_key"]) for r in whole.collect()} == got
    with pytest.raises(ValueError):
        engine.batch(spark.range(101).selectExpr("cast(id as int) as idx", "concat('/x', id) as value"))


def test_a_batch_that_is_stopped_or_takes_too_long(spark, engine, monkeypatch, tmp_path):
    import threading
    import time

    inputs = spark.createDataFrame([(1, "/api/order/save"), (2, "/bill/get-one"), (3, "/none")], "idx int, value string")
    stop = threading.Event()
    rows, result = engine.batch(inputs, progress=lambda done, n, value: done == 1 and stop.set(), stop=stop, chunk=1)
    assert sorted(r["idx"] for r in rows.collect()) == [1, 2]
    some, analysed = Engine.analyze, []
    monkeypatch.setattr(Engine, "analyze", lambda self, entries, options=None: analysed.append(sorted(r["root_id"] for r in entries.collect())) or some(self, entries, options))
    stop.clear()
    folder = f"{tmp_path}/ledger"
    engine.batch(inputs, progress=lambda done, n, value: done == 1 and stop.set(), stop=stop, chunk=1, ledger=folder)
    rows, result = engine.batch(inputs, ledger=folder)
    assert analysed == [["/api/order/save"], ["/bill/get-one"], ["/bill/get-one"]][: len(analysed)] and sum(a == ["/api/order/save"] for a in analysed) == 1
    whole, all_ = engine.batch(inputs)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(rows, whole) and same(result.resources, all_.resources) and same(result.edges, all_.edges)
    monkeypatch.setattr(Engine, "analyze", lambda self, entries, options=None: time.sleep(1.5))
    monkeypatch.setattr(Engine, "_held", staticmethod(lambda result: result))
    with pytest.raises(TimeoutError):
        engine._timed(lambda: time.sleep(1.5), 1)


def test_session(spark, engine):
    from ripplegraph.plans.session import Session

    stamp, got, said = [0], [], []
    session = Session(engine, lambda: stamp[0])
    end = session.subscribe(got.append)
    session.subscribe_status(lambda line, running: said.append(running))
    first = session.analyze_method("a.Http#call")
    assert session.analyze_method("a.Http#call") is first and got == [first, first] and said == [True, False]
    stamp[0] = 1
    assert session.analyze_method("a.Http#call") is not first
    end()
    session.cancel()
    session.analyze_input("/bill/get-one")
    assert len(got) == 3


def test_report_files_and_trees(spark, engine, run, tmp_path):
    inputs = spark.createDataFrame([(1, "/api/order/save")], "idx int, value string")
    rows, result = engine.batch(inputs)
    made = reports.write_report(spark, f"{tmp_path}/report.csv", rows, result)
    assert [m.rsplit("/", 1)[1] for m in made] == ["report.csv", "report.md", "report.xlsx"]
    lines = (tmp_path / "report.csv").read_text().splitlines()
    assert lines[0] == reports.header(reports.BATCH) and lines[1].startswith('"1","/api/order/save"')
    assert zipfile.ZipFile(tmp_path / "report.xlsx").namelist()[0] == "[Content_Types].xml"
    callees = {r["caller"]: r["callees"] for r in reports.adjacency(result.edges).collect()}
    assert callees["a.OrderController#save"] == ["a.Consumer#onOrder", "a.OrderService#save"]
    tree = reports.tree(result, "/api/order/save").collect()
    assert {r["depth"]: r["node"] for r in tree if r["depth"] == 0} == {0: "a.OrderController#save"}
    assert any(r["path"] == "a.OrderController#save -> a.OrderService#save -> a.OrderServiceImpl#save" for r in tree)


def test_settings():
    from ripplegraph.model import changed, effective

    assert Options().excluded_prefixes == ("java.", "javax.", "jakarta.", "kotlin.", "org.springframework.") and not Options().merge_resources
    own, shared = {"use_shared": True, "max_depth": 500}, {"max_depth": "7", "excluded_prefixes": "a., b.\nc.", "query_patterns": "x,y\nz", "service_mappings": "a=b\n# c=d\n e = f"}
    o = Options.of(effective(own, shared))
    assert (o.max_depth, o.excluded_prefixes, o.query_patterns, o.service_mappings) == (7, ("a.", "b.", "c."), ("x,y", "z"), {"a": "b", "e": "f"})
    assert Options.of(effective({"max_depth": 500, "row_timeout_seconds": -3}, shared)).max_depth == 100
    assert changed({"a": "x, y,x"}, {"a": "x\ny"}) == set() and changed({"a": "x"}, {"a": "y", "b": 1}) == {"a", "b"}


def test_expressions_in_parts_and_circles(spark, monkeypatch):
    """A task used to hold whatever came to it, and expressions in circles were followed for as many rounds as their number has bits."""
    from ripplegraph import storage
    from ripplegraph.operators import symbols
    from ripplegraph.plans.engine import facts_of

    rounds, dealt, some, deal = [], [], symbols.materialize, symbols.dealt
    monkeypatch.setattr(storage, "PART_ROWS", 50)
    monkeypatch.setattr(symbols, "materialize", lambda df, what: rounds.append(what) or some(df, what))
    monkeypatch.setattr(symbols, "dealt", lambda df, parts, *keys: dealt.append(parts) or deal(df, parts, *keys))
    exprs = [(f"c{i}", "ref", "", None, f"w{i}", []) for i in range(300)] + [(f"a{i}", "ref", "", None, f"v{i}", []) for i in range(9)] + [("a9", "literal", "", "end", None, [])]
    held = [(f"w{i}", "local", "x", "C", "s", f"c{i ^ 1}", 0) for i in range(300)] + [(f"v{i}", "local", "x", "C", "s", f"a{i + 1}", 0) for i in range(9)]
    got = {r["expr_id"]: r["value"] for r in symbols.expression_values(facts_of(spark, {"expr": exprs, "variable": held})).collect()}
    assert got == {f"a{i}": "end" for i in range(10)} and len(rounds) <= 6 and set(dealt) == {7}


def test_arguments_in_parts(spark, monkeypatch):
    """Arguments used to be gathered before they were dealt out by their call."""
    from ripplegraph import storage
    from ripplegraph.operators import extractors
    from ripplegraph.plans.engine import facts_of

    dealt, deal = [], extractors.dealt
    monkeypatch.setattr(storage, "PART_ROWS", 4)
    monkeypatch.setattr(extractors, "dealt", lambda df, parts, *keys: dealt.append((parts, *keys)) or deal(df, parts, *keys))
    args = [(f"k{i}", pos, f"x{i}-{pos}", "s", []) for i in range(5) for pos in (2, 0, 1)]
    exprs = [(f"x{i}-{pos}", "literal", f"t{pos}", None if pos == i else f"v{i}{pos}", None, []) for i in range(5) for pos in range(3)]
    c = extractors.contexts(facts_of(spark, {"call_arg": args, "expr": exprs}), Options())
    got = {r["ctx_id"]: tuple(r)[1:] for r in c.arguments.select("ctx_id", "values", "value0", "value1", "text0", "expr0").collect()}
    known = lambda i, pos: None if pos == i else f"v{i}{pos}"
    assert got == {f"c|k{i}": ([known(i, p) for p in range(3) if p != i], known(i, 0), known(i, 1), "t0", f"x{i}-0") for i in range(5)}
    assert (4, "call_id") in dealt


def test_compressed_tables_are_not_taken_for_small(spark):
    """Tables of ten megabytes on disk, hundreds in memory, used to go through the driver to be broadcast."""
    from ripplegraph.operators import extractors
    from ripplegraph.plans.engine import facts_of
    from ripplegraph.storage import materialize

    extractors.contexts(facts_of(spark, {}), Options())
    ids = materialize(spark.range(1_500_000).select(F.concat(F.lit("a.b.Class"), F.col("id").cast("string")).alias("k")), "sized")
    plan = ids.join(ids.withColumn("v", F.lit(1)), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_chains_of_any_length(spark):
    from ripplegraph.operators import symbols
    from ripplegraph.plans.engine import facts_of
    from ripplegraph.plans.reach import closure

    n = 70
    exprs = [(f"e{i}", "ref", "", None, f"v{i}", []) for i in range(n)] + [(f"e{n}", "literal", "", "deep", None, []), ("c0", "ref", "", None, "w0", []), ("c1", "ref", "", None, "w1", [])]
    held = [(f"v{i}", "local", "x", "C", "s", f"e{i + 1}", 0) for i in range(n)] + [("w0", "local", "x", "C", "s", "c1", 0), ("w1", "local", "x", "C", "s", "c0", 0)]
    got = {r["expr_id"]: r["value"] for r in symbols.expression_values(facts_of(spark, {"expr": exprs, "variable": held})).collect()}
    assert got == {f"e{i}": "deep" for i in range(n + 1)}
    pairs = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(40)] + [("k40", "k0")], "sub string, super string")
    assert closure(pairs).filter("sub = 'k0'").agg({"depth": "max"}).first()[0] == 40
    supers = [("p", f"t{i}", f"t{i + 1}", ["T"], 0) for i in range(20)]
    classes = [("p", f"t{i}", f"t{i}", "class", False, False, ["T"], True) for i in range(21)]
    up = symbols.ancestors(facts_of(spark, {"supertype": supers, "src_class": classes}), spark.createDataFrame([("s", "t0", ["E"])], "start string, class_fqn string, args array<string>"))
    assert up.filter("class_fqn = 't20'").first()["args"] == ["E"]


def test_addresses_of_any_depth(spark):
    """Addresses used to be followed for six steps; beyond these their parts were lost."""
    from ripplegraph.operators import symbols
    from ripplegraph.plans.engine import facts_of

    exprs, held, want = [], [], {}

    def add(eid, kind, value, const=None, ref=None, operands=()):
        exprs.append((eid, kind, "", const, ref, list(operands)))
        if value is not None:
            want[eid] = value

    n = 40
    for i in range(n):  # a variable that holds a concatenation with the next variable, to and fro
        add(f"r{i}", "ref", "".join(f"<{j}" for j in range(i, n)) + "end" + "".join(f">{j}" for j in reversed(range(i, n))), ref=f"v{i}")
        add(f"c{i}", "polyadic", want[f"r{i}"], operands=[f"a{i}", "gone", f"r{i + 1}", f"b{i}"])
        add(f"a{i}", "literal", f"<{i}", f"<{i}")
        add(f"b{i}", "literal", f">{i}", f">{i}")
        held.append((f"v{i}", "local", "x", "C", "s", f"c{i}", 0))
    add(f"r{n}", "literal", "end", "end")
    for i in range(9):  # formats within formats, and a value that is used twice
        add(f"f{i}", "format", "(" * (9 - i) + "x" + ")" * (9 - i) + "%", operands=["t0" if i else "t1", f"f{i + 1}"])
        add(f"d{i}", "polyadic", "y" * 2 ** (9 - i), operands=[f"d{i + 1}", f"d{i + 1}"])
    want |= {f"f{i}": "(" * (9 - i) + "x" + ")" * (9 - i) for i in range(9)} | {"f0": "(" * 9 + "x" + ")" * 9 + "%"}
    add("f9", "literal", "x", "x")
    add("d9", "literal", "y", "y")
    add("t0", "literal", "(%s)", "(%s)")
    add("t1", "literal", "(%s)%%", "(%s)%%")
    add("n0", "polyadic", None, operands=["n1"])  # nothing at the end
    for i in range(1, 9):
        add(f"n{i}", "polyadic", None, operands=[f"n{i + 1}"])
    add("n9", "ref", None, ref="?")
    add("m0", "polyadic", "m", operands=["n0", "m1"])
    add("m1", "literal", "m", "m")
    add("m2", "format", None, operands=["t0", "n3"])
    add("m3", "format", None, operands=["t0"])
    add("o0", "polyadic", "o", operands=["m1x", "o1", "o2"])  # o0 -> o1 -> o3 -> o0: operands that lead back are left out
    add("o1", "polyadic", "p", operands=["o3", "o4"])
    add("o2", "literal", "o", "o")
    add("o3", "polyadic", None, operands=["o0"])
    add("o4", "literal", "p", "p")
    add("o5", "polyadic", "op", operands=["o0", "o1"])
    add("o6", "polyadic", "q", operands=["o6", "o7"])
    add("o7", "literal", "q", "q")
    got = {r["expr_id"]: r["value"] for r in symbols.urls(facts_of(spark, {"expr": exprs, "variable": held})).collect()}
    assert got == want

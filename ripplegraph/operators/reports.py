"""Reports: rows, lines and cells as DataFrames; only a workbook is put together on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.model import CONFIDENCE, EXTERNAL_OPERATIONS, OPERATIONS, RESOURCE_TYPES, ROW_STATUS
from ripplegraph.plans.engine import Result
from ripplegraph.plans.reach import unfold
from ripplegraph.storage import write_file, write_text

NONE = "无"
# Headers.
DETAIL = ["入口类型", "入口", "资源类型", "资源名称", "操作", "置信度", "调用路径与证据"]
BATCH = ["序号", "输入URL", "状态", "跳过/失败原因", "HTTP方法", "入口", "分析方法", "方法数", "资源数", "资源类型", "资源名称", "操作", "置信度", "证据"]
OVERVIEW = ["入口类型", "入口", "状态", "调用链摘要", "MySQL表", "Redis key", "ES索引", "MongoDB表", "Kafka topic", "RabbitMQ queue", "RocketMQ topic", "外围接口"]
INTERFACES = ["序号", "输入URL", "状态", "原因", "HTTP方法", "入口", "分析方法", "方法数", "资源数"]
SUMMARY = ["序号", "输入URL", "MySQL", "Redis", "Kafka", "RabbitMQ", "RocketMQ", "外围接口", "警告"]
SHEETS = ["总览", "接口结果", "资源汇总"]
CONSTRUCTOR_WARNING = r"^无法解析方法引用：.*::new$"


def label_of(code: Column, labels: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def operation_label(kind: Column, operation: Column) -> Column:
    external = F.when(kind == "EXTERNAL_HTTP", label_of(operation, EXTERNAL_OPERATIONS))
    return F.coalesce(external, label_of(operation, OPERATIONS))


def labelled(resources: DataFrame) -> DataFrame:
    """Resources with their labels, as a view shows them."""
    return resources.select(
        "root_id", "ord", label_of(F.col("type"), RESOURCE_TYPES).alias("type_label"), "name", operation_label(F.col("type"), F.col("operation")).alias("operation_label"),
        label_of(F.col("conf_rank"), CONFIDENCE).alias("confidence_label"), "detail", "type", "operation", "conf_rank",
    )


def _entry(result: Result) -> DataFrame:
    return result.entries.groupBy("root_id").agg(F.min("type").alias("entry_type"), F.min("display").alias("display"), F.min("http_method").alias("http_method"))


def _csv(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[text.csv_field(F.coalesce(c.cast("string"), F.lit(""))) for c in columns])


def header(names: list[str]) -> str:
    return "\ufeff" + ",".join(f'"{n}"' for n in names)


def detail_csv(result: Result) -> DataFrame:
    """(root_id, ord, line): a line for each resource."""
    rows = labelled(result.resources).join(_entry(result), "root_id")
    cells = [F.col(c) for c in ("entry_type", "display", "type_label", "name", "operation_label", "confidence_label", "detail")]
    return rows.select("root_id", "ord", _csv(cells).alias("line"))


def mermaid(result: Result) -> DataFrame:
    """(root_id, part, ord, line): nodes, edges and resources of a flow chart."""
    m = result.methods.select("root_id", F.lit(0).alias("part"), F.col("label").alias("ord"), F.concat(F.lit("  "), text.node_id(F.col("method_key")), F.lit('["'), text.quote_label(F.concat(F.col("project"), F.lit("："), F.col("label"))), F.lit('"]')).alias("line"))
    e = result.edges.select("root_id", F.lit(1), F.concat("caller", "callee"), F.concat(F.lit("  "), text.node_id(F.col("caller")), F.lit(" -->|"), label_of(F.col("conf_rank"), CONFIDENCE), F.lit("| "), text.node_id(F.col("callee"))))
    root = result.entries.groupBy("root_id").agg(F.min("method_key").alias("root"))
    r = result.resources.join(root, "root_id")
    rid = F.concat(F.lit("resource_"), F.substring(F.md5(F.concat_ws("|", "type", "name", "operation", "detail").cast("binary")), 1, 12))
    name = text.quote_label(F.concat(label_of(F.col("type"), RESOURCE_TYPES), F.lit(": "), F.col("name")))
    n = r.select("root_id", F.lit(2), F.concat(F.col("type"), F.lit("|"), "name"), F.concat(F.lit("  "), rid, F.lit('[("'), name, F.lit('")]')))
    u = r.select("root_id", F.lit(3), F.concat(F.col("type"), F.lit("|"), "name"), F.concat(F.lit("  "), text.node_id(F.col("root")), F.lit(" -.-> "), rid))
    return m.union(e).union(n).union(u)


def counts(result: Result) -> DataFrame:
    """(root_id, methods, resources, warnings, status) of each result."""
    m = result.methods.groupBy("root_id").agg(F.countDistinct("method_key").alias("methods"))
    r = result.resources.groupBy("root_id").agg(F.count("*").alias("resources"), F.bool_or(F.col("conf_rank") == 2).alias("_open"))
    w = result.warnings.groupBy("root_id").agg(F.count("*").alias("warnings"))
    out = m.join(r, "root_id", "left").join(w, "root_id", "left").na.fill({"resources": 0, "warnings": 0})
    return out.select("root_id", "methods", "resources", "warnings", F.when(F.coalesce("_open", F.lit(False)), "待确认").otherwise("已完成").alias("status"))


def _cell(condition: Column, value: Column, between: str) -> Column:
    """Values of the rows that hold, in order, or the mark of an empty cell."""
    held = F.array_sort(F.collect_list(F.when(condition, F.struct("ord", value.alias("v")))))
    return F.coalesce(text.blank_to_null(F.array_join(F.transform(held, lambda x: x["v"]), between)), F.lit(NONE))


def summaries(result: Result, markdown: bool) -> DataFrame:
    """(root_id, a cell for each resource type) of each result."""
    between = "<br>" if markdown else "\n"
    name = F.concat(F.lit("`"), text.markdown(F.col("name")), F.lit("`")) if markdown else F.col("name")
    op, kind = F.col("operation_label"), F.col("type")
    lines = F.concat(op, F.lit("："), name)
    other = ~F.col("operation").isin("READ", "WRITE")
    cells = labelled(result.resources).groupBy("root_id").agg(
        F.count_if(kind == "MYSQL").alias("_n"),
        _cell((kind == "MYSQL") & (F.col("operation") == "WRITE"), name, between).alias("_w"),
        _cell((kind == "MYSQL") & (F.col("operation") == "READ"), name, between).alias("_r"),
        _cell((kind == "MYSQL") & other, F.concat(name, F.lit("（"), op, F.lit("）")), "，").alias("_o"),
        _cell(kind == "REDIS", name, between).alias("redis"),
        *[_cell(kind == k, lines, between).alias(k.lower()) for k in ("KAFKA", "RABBITMQ", "ROCKETMQ", "EXTERNAL_HTTP")],
        F.bool_or(F.col("conf_rank") == 2).alias("open"),
    )
    extra = F.when(F.col("_o") != NONE, F.concat(F.lit(between + "其他："), "_o")).otherwise("")
    mysql = F.when(F.col("_n") == 0, NONE).otherwise(F.concat(F.lit("写入："), "_w", F.lit(between + "只读："), "_r", extra))
    return cells.select("root_id", mysql.alias("mysql"), "redis", "kafka", "rabbitmq", "rocketmq", "external_http", "open", F.col("_w").alias("writes"), F.col("_r").alias("reads"))


def overview(result: Result) -> DataFrame:
    """(root_id, line): one Markdown row a result; its chain shows the first eight methods."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("depth", F.lit(1 << 20)).alias("d"), F.concat(F.col("project"), F.lit("："), F.col("label")).alias("l")))), 1, 8)
    chain = result.methods.groupBy("root_id").agg(F.array_join(F.transform(first, lambda x: x["l"]), " -> ").alias("chain"))
    s = _entry(result).join(chain, "root_id", "left").join(summaries(result, True), "root_id", "left")
    cell = lambda c: F.coalesce(c, F.lit(NONE))
    cells = ["entry_type", F.concat(F.lit("`"), "display", F.lit("`")), F.when(F.coalesce("open", F.lit(False)), "待确认").otherwise("已完成"), cell("chain"),
             F.concat(F.lit("写入："), cell("writes"), F.lit("<br>只读："), cell("reads")), cell("redis"), F.lit(NONE), F.lit(NONE), cell("kafka"), cell("rabbitmq"), cell("rocketmq"), cell("external_http")]
    return s.select("root_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def batch_rows(batch: DataFrame, result: Result) -> DataFrame:
    """Batch rows with entry, analysed method and counts."""
    m = result.methods.select(F.col("root_id").alias("input"), "method_key", F.col("label").alias("analyzed"))
    n = counts(result).select(F.col("root_id").alias("input"), "methods", "resources")
    e = _entry(result).select(F.col("root_id").alias("input"), "display", "http_method")
    out = batch.join(e, "input", "left").join(m, ["input", "method_key"], "left").join(n, "input", "left").na.fill({"methods": 0, "resources": 0})
    return out.withColumn("status_label", label_of(F.col("status"), ROW_STATUS))


def batch_csv(batch: DataFrame, result: Result) -> DataFrame:
    """(idx, ord, line): a line for each resource of a row, one for a row without any."""
    r = labelled(result.resources).withColumnRenamed("root_id", "input")
    rows = batch_rows(batch, result).join(r, "input", "left")
    cells = [F.col(c) for c in ("idx", "input", "status_label", "reason", "http_method", "display", "analyzed", "methods", "resources", "type_label", "name", "operation_label", "confidence_label", "detail")]
    return rows.select("idx", "ord", _csv(cells).alias("line"))


def interfaces(batch: DataFrame, result: Result, markdown: bool) -> DataFrame:
    """(idx, status, reason, input, status_label, cells) of each row of a batch."""
    plain, ticked = _shown(markdown)
    cells = [F.col("idx").cast("string"), ticked("input"), F.col("status_label"), *[F.coalesce(text.blank_to_null(plain(c)), F.lit(NONE)) for c in ("reason", "http_method", "display", "analyzed")], F.col("methods").cast("string"), F.col("resources").cast("string")]
    return batch_rows(batch, result).select("idx", "status", "reason", "input", "status_label", F.array(*cells).alias("cells"))


def resource_summaries(batch: DataFrame, result: Result, markdown: bool) -> DataFrame:
    """(idx, cells) of each row that succeeded: its resources by type, and its warnings but those of constructors."""
    plain, ticked = _shown(markdown)
    shown = result.warnings.filter(~F.col("message").rlike(CONSTRUCTOR_WARNING)).groupBy("root_id").agg(F.array_join(F.array_sort(F.collect_set("message")), ", ").alias("warned"))
    rows = batch.filter("status = 'SUCCESS'").withColumn("root_id", F.col("input")).join(summaries(result, markdown), "root_id", "left").join(shown, "root_id", "left")
    kinds = [F.coalesce(k, F.lit(NONE)) for k in ("mysql", "redis", "kafka", "rabbitmq", "rocketmq", "external_http")]
    return rows.select("idx", F.array(F.col("idx").cast("string"), ticked("input"), *kinds, F.coalesce(text.blank_to_null(plain("warned")), F.lit(NONE))).alias("cells"))


def _shown(markdown: bool) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    """How a value, and one between ticks, is shown in Markdown or in a sheet."""
    plain = lambda c: text.markdown(F.coalesce(c, F.lit(""))) if markdown else F.coalesce(c, F.lit(""))
    return plain, lambda c: F.concat(F.lit("`"), plain(c), F.lit("`")) if markdown else plain(c)


def _statuses(batch: DataFrame) -> DataFrame:
    return batch.agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in ROW_STATUS])


def batch_lines(batch: DataFrame, result: Result, title: str = "批量统计", canceled: bool = False) -> DataFrame:
    """(part, idx, line) of the Markdown report of a batch, in the order of part and idx."""
    spark = batch.sparkSession
    fixed = lambda part, *rows: spark.createDataFrame([(part, i, x) for i, x in enumerate(rows)], "part int, idx int, line string")
    head = lambda names: ("| " + " | ".join(names) + " |", "|" + "---|" * len(names))
    table = lambda part, rows: rows.select(F.lit(part).alias("part"), "idx", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("line"))
    n = _statuses(batch)
    told = [F.concat(F.lit(f"- {label}："), F.col(c).cast("string")) for label, c in (("总输入数", "all"), ("成功", "SUCCESS"), ("跳过", "SKIPPED"), ("失败", "FAILED"))]
    counted = n.select(F.lit(1).alias("part"), F.posexplode(F.array(*told)).alias("idx", "line"))
    rows = interfaces(batch, result, True)
    odd = rows.filter("status <> 'SUCCESS'")
    details = odd.select(F.lit(8).alias("part"), "idx", F.concat(F.lit("- "), F.col("idx").cast("string"), F.lit(". `"), "input", F.lit("`："), "status_label", F.lit("，"), F.coalesce("reason", F.lit(""))).alias("line"))
    some = n.select(F.lit(5).alias("part"), F.posexplode(F.when(F.col("SUCCESS") > 0, F.array(*[F.lit(x) for x in head(SUMMARY)])).otherwise(F.array(F.lit("无成功接口。")))).alias("idx", "line"))
    wrong = n.filter(F.col("SUCCESS") < F.col("all")).select(F.lit(7).alias("part"), F.posexplode(F.array(F.lit(""), F.lit("## 跳过与失败明细"), F.lit(""))).alias("idx", "line"))
    state = ("- 执行状态：用户取消，已导出完成部分",) if canceled else ()
    parts = [fixed(0, f"# {title}", "", "## 总览", ""), counted, fixed(2, *state, "", "## 接口结果", "", *head(INTERFACES)), table(3, rows), fixed(4, "", "## 资源汇总", ""), some, table(6, resource_summaries(batch, result, True)), wrong, details]
    return reduce(DataFrame.unionByName, parts)


def batch_markdown(batch: DataFrame, result: Result, title: str = "批量统计", canceled: bool = False) -> str:
    """The Markdown report of a batch, whose number of rows ``Engine.batch`` bounds."""
    return "\n".join(r["line"] for r in batch_lines(batch, result, title, canceled).orderBy("part", "idx").collect()) + "\n"


def sheet_rows(batch: DataFrame, result: Result, canceled: bool = False) -> DataFrame:
    """(sheet, at, cells) of a batch's workbook, sheets from 1; heads come first, then the rows in the order of ``at``."""
    pair = lambda label, v: F.array(F.lit(label), v)
    counted = [pair(label, F.col(c).cast("string")) for label, c in (("总输入数", "all"), ("成功", "SUCCESS"), ("跳过", "SKIPPED"), ("失败", "FAILED"))]
    state = pair("执行状态", F.lit("用户取消，已导出完成部分" if canceled else "扫描完成"))
    first = _statuses(batch).select(F.lit(1).alias("sheet"), F.posexplode(F.array(pair("指标", F.lit("值")), *counted, state)).alias("at", "cells"))
    heads = batch.sparkSession.createDataFrame([(2, -1, INTERFACES), (3, -1, SUMMARY)], "sheet int, at int, cells array<string>")
    body = lambda sheet, rows: rows.select(F.lit(sheet).alias("sheet"), F.col("idx").alias("at"), "cells")
    return reduce(DataFrame.unionByName, [first, heads, body(2, interfaces(batch, result, False)), body(3, resource_summaries(batch, result, False))])


def batch_workbook(batch: DataFrame, result: Result, canceled: bool = False) -> bytes:
    """Three sheets: overview, interfaces, resources."""
    sheets: dict[str, list[list[str]]] = {name: [] for name in SHEETS}
    for r in sheet_rows(batch, result, canceled).orderBy("sheet", "at").collect():
        sheets[SHEETS[r["sheet"] - 1]].append(r["cells"])
    return workbook(sheets)


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """An Office Open XML workbook of text cells."""
    esc = lambda v: "".join({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}.get(c, c) for c in v if c >= " " or c in "\t\n\r")
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    numbers = range(1, len(sheets) + 1)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
    }
    for i, rows in zip(numbers, sheets.values(), strict=True):
        cell = lambda r, c, v: f'<c r="{text.column_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, head + content)
    return out.getvalue()


def operation_groups(resources: DataFrame, kind: str) -> DataFrame:
    """(root_id, cell): names of a type, a line for each operation."""
    rows = labelled(resources).filter(F.col("type") == kind)
    one = rows.groupBy("root_id", "operation_label").agg(F.min("ord").alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), "，").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", F.concat("operation_label", F.lit("："), "n").alias("l")))), lambda x: x["l"])
    return one.groupBy("root_id").agg(F.array_join(lines, "\n").alias("cell"))


def sibling(path: str, extension: str) -> str:
    """``path`` if it ends with the extension, else the same name with it."""
    if path.lower().endswith(f".{extension}"):
        return path
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.rpartition('.')[0] or name}.{extension}"


def write_lines(lines: DataFrame, path: str, order: list[str], first: list[str] = ()) -> None:
    """Lines in order as text files below ``path``; ``first`` stands before them."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(i, x) for i, x in enumerate(first)], "_i int, line string").select(F.lit(0).alias("_part"), F.col("_i").cast("string").alias("_key"), "line")
    body = lines.orderBy(*order).select(F.lit(1).alias("_part"), F.lit("").alias("_key"), "line", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    both = head.unionByName(body, allowMissingColumns=True)
    both.orderBy("_part", "_key", *[f"_o{i}" for i in range(len(order))]).select("line").write.mode("overwrite").text(path)


def write_report(spark: SparkSession, path: str, batch: DataFrame, result: Result, formats: tuple[str, ...] = ("csv", "md", "xlsx"), title: str = "批量统计", canceled: bool = False) -> list[str]:
    """One file for each format of a batch, named like ``path`` with the format's extension; their paths."""
    made = []
    for kind in formats:
        made.append(sibling(path, kind))
        if kind == "csv":
            write_text(batch_csv(batch, result).orderBy("idx", "ord"), made[-1], header(BATCH) + "\n")
        elif kind == "md":
            write_text(batch_lines(batch, result, title, canceled).orderBy("part", "idx"), made[-1], "")
        else:
            write_file(spark, made[-1], batch_workbook(batch, result, canceled))
    return made


def adjacency(edges: DataFrame) -> DataFrame:
    """(root_id, caller, callees) of the edges of a result, callees in the order of their calls."""
    once = edges.groupBy("root_id", "caller", "callee").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "callee")))
    return once.groupBy("root_id", "caller").agg(F.transform(ordered, lambda x: x["callee"]).alias("callees"))


def tree(result: Result, root_id: str, max_depth: int = 30) -> DataFrame:
    """(path, node, depth, repeated) of the call tree of one entry, by the edges of its result."""
    edges = result.edges.filter(F.col("root_id") == root_id).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    first = result.entries.filter(F.col("root_id") == root_id).agg(F.min("method_key").alias("k")).first()
    return unfold(edges, (first and first["k"]) or "", max_depth)


def view(resources: DataFrame, kind: str | None = None, name: str | None = None, operation: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Resources of a type, with a part of a name, of an operation, sorted by the columns ``order`` if there are any."""
    out = resources
    if kind:
        out = out.filter(F.col("type") == kind)
    if name:
        out = out.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    if operation:
        out = out.filter(F.col("operation") == operation)
    return out.orderBy(*order) if order else out

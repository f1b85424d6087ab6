"""Inputs of a batch run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ripplegraph.functions import text

MOST_INPUTS = 100
SHOWN_ERRORS, SHOWN_DUPLICATES = 20, 10
# Messages by code.
MESSAGES = {
    "no_leading_slash": "必须以 `/` 开头，请输入接口路径，不要输入完整 URL。",
    "root_only": "不能只输入根路径 `/`。",
    "white_space": "路径中不能包含空格或制表符；请确认是否一行写了多个接口。",
    "scheme_or_host": "请只输入路径部分，例如 `/api/order/save`。",
    "query_or_fragment": "请只输入路径，不要包含 query 参数或 fragment。",
}


def lines(spark: SparkSession, raw: str) -> DataFrame:
    """(line_no, value): trimmed lines that aren't blank."""
    return split_lines(spark.createDataFrame([(raw,)], "raw string"))


def split_lines(texts: DataFrame) -> DataFrame:
    """``texts`` (raw, ...) with (line_no, value) for each line that isn't blank, trimmed, instead of raw."""
    rest = [c for c in texts.columns if c != "raw"]
    split = texts.select(*rest, F.posexplode(F.split("raw", "\r\n|\r|\n")).alias("_at", "_line"))
    return split.select(*rest, (F.col("_at") + 1).alias("line_no"), F.regexp_replace("_line", r"^\s+|\s+$", "").alias("value")).filter("value <> ''")


def validate(inputs: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """``inputs`` with ``error`` (a code or null) and ``duplicate``: whether an earlier line without error, by ``order``, has the value."""
    checked = inputs.withColumn("error", text.path_error(F.col("value")))
    first = F.row_number().over(W.partitionBy("value").orderBy(*order)) > 1
    return checked.withColumn("duplicate", F.col("error").isNull() & first)


def messages(checked: DataFrame) -> DataFrame:
    """(kind, at, said) about validated inputs: an error for each of the first wrong lines and one for the rest, and notes on duplicates."""
    fine = F.col("error").isNull() & ~F.col("duplicate")
    n = checked.agg(F.count_if(fine).alias("good"), F.count_if(F.col("error").isNotNull()).alias("wrong"), F.count_if("duplicate").alias("again"))
    last = (1 << 62) - 1

    def told(rows: DataFrame, kind: str, at: Column | int, *parts: str | Column) -> DataFrame:
        said = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return rows.select(F.lit(kind).alias("kind"), (F.lit(at) if isinstance(at, int) else at).cast("long").alias("at"), said.alias("said"))

    line, value = F.col("line_no"), F.col("value")
    why = reduce(lambda w, m: w.when(F.col("error") == m[0], m[1]), list(MESSAGES.items())[1:], F.when(F.col("error") == next(iter(MESSAGES)), next(iter(MESSAGES.values()))))
    found = [
        told(checked.filter("error is not null").orderBy("line_no").limit(SHOWN_ERRORS), "error", line, "第 ", line, " 行 `", value, "`：", why),
        told(n.filter(F.col("wrong") > SHOWN_ERRORS), "error", last, "还有 ", F.col("wrong") - SHOWN_ERRORS, " 条错误未显示。"),
        told(n.filter("good = 0 and wrong = 0"), "error", last + 1, "请输入至少一个 HTTP 接口路径。"),
        told(n.filter(F.col("good") > MOST_INPUTS), "error", last + 1, f"批量统计单次最多支持 {MOST_INPUTS} 个去重后的接口，当前为 ", F.col("good"), " 个。"),
        told(n.filter("again > 0"), "note", 0, "已自动去重 ", F.col("again"), " 行重复接口，将仅扫描 ", F.col("good"), " 个唯一接口。"),
        told(checked.filter("duplicate").orderBy("line_no").limit(SHOWN_DUPLICATES), "note", line, "- 第 ", line, " 行重复：`", value, "`"),
        told(n.filter(F.col("again") > SHOWN_DUPLICATES), "note", last, "- 还有 ", F.col("again") - SHOWN_DUPLICATES, " 行重复未显示。"),
    ]
    return reduce(DataFrame.unionByName, found)


def accepted(checked: DataFrame) -> tuple[list[str], list[str], str]:
    """(values to run, error messages, note on duplicates); at most one more than the limit is brought to the driver."""
    good = [r["value"] for r in checked.filter("error is null and not duplicate").orderBy("line_no").limit(MOST_INPUTS + 1).collect()]
    told = messages(checked).orderBy("at").collect()  # bounded by the limits of what is shown
    return good, [r["said"] for r in told if r["kind"] == "error"], "\n".join(r["said"] for r in told if r["kind"] == "note")

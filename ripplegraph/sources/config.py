"""Configuration files to key-value rows, and placeholders resolved with them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.plans.reach import closure
from ripplegraph.storage import drop, materialize

EXTENSIONS = {"properties": 0, "yml": 1, "yaml": 2}  # a later one overwrites an earlier one
PLACEHOLDER = r"\$\{([^}:]+)(?::([^}]*))?\}"
BLANK_ENDS = r"(?U)^\s+|\s+$"
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def properties(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, key, value) by the grammar of property files: continuations, escapes, ``=``, ``:`` or space between."""
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        number, line = i + 1, lines[i].lstrip(" \t\f")
        i += 1
        if not line or line[0] in "#!":
            continue
        while (len(line) - len(line.rstrip("\\"))) % 2 and i < len(lines):
            line = line[:-1] + lines[i].lstrip(" \t\f")
            i += 1
        at = 0
        while at < len(line) and line[at] not in "=: \t\f":
            at += 2 if line[at] == "\\" else 1
        key, rest = line[:at], line[at:].lstrip(" \t\f")
        if rest[:1] in ("=", ":"):
            rest = rest[1:].lstrip(" \t\f")
        yield number, _unescape(key), _unescape(rest)


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2])

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, text)


def unquote(value: str) -> str:
    """Without one pair of double quotes, then one of single quotes."""
    for quote in "\"'":
        if len(value) >= 2 and value[0] == value[-1] == quote:
            value = value[1:-1]
    return value


def yaml(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, dotted key, value) of a plain YAML file: keys nest by indent and stay as written; lists and anchors have no meaning."""
    stack: list[tuple[int, str]] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #", 1)[0]
        body = line.strip()
        key, colon, value = (x.strip() for x in body.partition(":"))
        if body.startswith("#") or not colon or not key:
            continue
        indent = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if value:
            yield number, ".".join([*(k for _, k in stack), key]), unquote(value)
        else:
            stack.append((indent, key))


def read_files(spark: SparkSession, path: str, project: str) -> DataFrame:
    """``config_file`` rows of the configuration files below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{properties,yml,yaml}")
    files = files.select(F.lit(project).alias("project"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    extension = F.element_at(F.split("path", r"\."), -1)
    rank = F.when(extension == "properties", 0).when(extension == "yml", 1).otherwise(2)
    return files.select("project", rank.alias("ext_rank"), "path", "text")


def key_values(files: DataFrame) -> DataFrame:
    """(project, key, value): the value written last, by extension, path and line."""
    schema = "project string, ext_rank int, path string, line_no int, key string, value string"

    def parse(batches):
        for batch in batches:
            rows = [
                (r.project, r.ext_rank, r.path, line, key, value)
                for r in batch.itertuples(index=False)
                for line, key, value in (properties(r.text or "") if r.ext_rank == 0 else yaml(r.text or ""))
            ]
            yield pd.DataFrame(rows, columns=["project", "ext_rank", "path", "line_no", "key", "value"])

    lines = files.select("project", "ext_rank", "path", "text").mapInPandas(parse, schema)
    return lines.groupBy("project", "key").agg(F.max_by("value", F.struct("ext_rank", "path", "line_no")).alias("value"))


@dataclass
class Expanded:
    """A configuration whose own placeholders are replaced: ``known`` (project, key, value, _nested, _cyclic); ``parts`` and ``rings``
    (project, key, parts) of the keys that hold placeholders, those on a cycle apart. Both are None where no value holds one."""

    known: DataFrame
    parts: DataFrame | None = None
    rings: DataFrame | None = None


def _part(text: Column | str, key: Column | None = None, ring: Column | None = None, other: Column | None = None, seen: Column | None = None) -> Column:
    """A piece of a value: plain text, or a placeholder that is still open, by its key or, if that is on a cycle, its ring."""
    none = F.lit(None).cast("string")
    get = lambda c: none if c is None else c
    path = F.array().cast("array<string>") if seen is None else seen
    return F.struct(F.col(text).alias("text") if isinstance(text, str) else text.alias("text"), get(key).alias("key"), get(ring).alias("ring"), get(other).alias("other"), path.alias("seen"))


def _cut(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``parts`` of a value, placeholders open."""
    rows = rows.withColumn("_whole", F.regexp_extract_all(value, F.lit(PLACEHOLDER), F.lit(0))).withColumn("_plain", F.split(value, PLACEHOLDER, -1))

    def one(plain: Column, i: Column) -> Column:
        whole = F.get("_whole", i)
        key = F.regexp_replace(F.regexp_extract(whole, PLACEHOLDER, 1), BLANK_ENDS, "")
        return F.array(_part(plain), _part(whole, key, None, F.regexp_extract(whole, PLACEHOLDER, 2)))

    kept = F.filter(F.flatten(F.transform("_plain", one)), lambda p: p["text"] != "")
    return rows.withColumn("parts", kept).drop("_whole", "_plain")


def _put(rows: DataFrame, field: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (project, _id, parts) with parts whose ``field`` is set replaced by what ``found`` adds to them; where that is nothing they stay.

    Only the open parts are sent to the table that knows them; texts between stay in their row.
    """
    opened = rows.select("project", "_id", F.posexplode("parts").alias("_at", "_p")).filter(F.col(f"_p.{field}").isNotNull())
    opened = opened.select("project", "_id", "_at", F.col("_p.text").alias("text"), F.col(f"_p.{field}").alias("key"), F.col("_p.other").alias("other"), F.col("_p.seen").alias("seen"))
    got = found(opened).groupBy("project", "_id").agg(F.map_from_entries(F.collect_list(F.struct("_at", "found"))).alias("_got"))
    put = F.transform("parts", lambda p, i: F.coalesce(F.try_element_at("_got", i), F.array(p)))
    return rows.join(got, ["project", "_id"], "left").select("project", "_id", F.flatten(put).alias("parts"))


def _settle(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Placeholders of plain keys and of unknown ones become text; those of keys on a cycle become rings."""
    text = F.coalesce("value", F.when(F.col("other") != "", F.col("other")).otherwise(F.col("text")))
    part = F.when(F.col("_cyclic"), _part("text", None, F.col("key"))).when(F.col("_nested").isNull() | ~F.col("_nested"), _part(text))
    return _put(rows, "key", lambda opened: opened.join(known, ["project", "key"], "left").withColumn("found", F.when(part.isNotNull(), F.array(part))))


def _fill(rows: DataFrame, table: DataFrame) -> DataFrame:
    return _put(rows, "key", lambda opened: opened.join(table.withColumnRenamed("parts", "found"), ["project", "key"]))


def _is_open(field: str) -> Column:
    return F.exists("parts", lambda p: p[field].isNotNull())


def expanded(config: DataFrame) -> Expanded:
    """A configuration (project, key, value) with the placeholders in its own values replaced.

    Each round puts the parts of all keys into each other, which doubles the depth that is done: nesting of fifty takes six
    rounds. Keys on a cycle are found by a closure and left open, since what they become depends on the way to them.
    """
    config = config.select("project", "key", "value")
    nested = config.filter(F.contains("value", F.lit("${")))
    if nested.isEmpty():
        return Expanded(config.withColumns({"_nested": F.lit(False), "_cyclic": F.lit(False)}))
    cut = _cut(nested, "value").select("project", F.col("key").alias("_id"), "parts")
    name = lambda p, k: F.concat(F.col(p), F.lit("\u0000"), F.col(k))
    links = cut.select(name("project", "_id").alias("sub"), F.explode("parts").alias("p"), "project").filter("p.key is not null")
    links = links.select("sub", F.concat("project", F.lit("\u0000"), F.col("p.key")).alias("super")).distinct()
    links = materialize(links.join(links.select(F.col("sub").alias("super")).distinct(), "super", "left_semi").select("sub", "super"), "links")
    if links.isEmpty():  # no value leads to another that holds a placeholder
        drop(links)
        known = config.withColumns({"_nested": F.contains("value", F.lit("${")), "_cyclic": F.lit(False)})
        return Expanded(known, materialize(_settle(cut, known), "parts").withColumnRenamed("_id", "key"))
    back = links.select(F.col("sub").alias("ancestor"), F.col("super").alias("sub"))
    around = closure(links).join(back, ["sub", "ancestor"], "left_semi").select("sub").unionByName(links.filter("sub = super").select("sub"))
    around = around.distinct().select(F.substring_index("sub", "\u0000", 1).alias("project"), F.expr("substr(sub, instr(sub, '\u0000') + 1)").alias("key"), F.lit(True).alias("_ring"))
    known = config.join(around, ["project", "key"], "left").withColumns({"_nested": F.contains("value", F.lit("${")), "_cyclic": F.coalesce("_ring", F.lit(False))}).drop("_ring")
    known = materialize(known, "known")
    parts = materialize(_settle(cut, known), "parts")
    while not parts.filter(_is_open("key")).isEmpty():
        nxt = materialize(_fill(parts, parts.select("project", F.col("_id").alias("key"), "parts")), "parts")
        drop(parts)
        parts = nxt
    done = parts.select("project", F.col("_id").alias("key"), "parts")
    rings = done.join(known.filter("_cyclic").select("project", "key"), ["project", "key"], "left_semi")
    return Expanded(known, done, None if rings.isEmpty() else rings)


def _around(opened: DataFrame, rings: DataFrame) -> DataFrame:
    """One step along cycles: a key that is met again on its own way stays as it is written."""
    further = F.transform("_parts", lambda p: F.when(p["ring"].isNull(), p).otherwise(_part(p["text"], None, p["ring"], None, F.array_append("seen", F.col("key")))))
    again = F.array(_part("text"))
    return opened.join(rings.withColumnRenamed("parts", "_parts"), ["project", "key"]).withColumn("found", F.when(F.array_contains("seen", F.col("key")), again).otherwise(further))


def resolve(rows: DataFrame, config: DataFrame | Expanded, column: str, out: str) -> DataFrame:
    """``rows`` (project, ``column``, ...) with ``out``: the value with placeholders replaced from the project's configuration, nested ones too.

    Only distinct values that hold a placeholder take part. Cycles, and unknown keys without default, stay as they are written, and so does
    all of a project without configuration. A step along a cycle is a round; all else takes no more than two joins.
    """
    if not isinstance(config, Expanded):
        config = expanded(config)
    held = rows.filter(F.contains(F.col(column), F.lit("${"))).select("project", F.col(column).alias("_id")).distinct()
    held = held.join(config.known.select("project").distinct(), "project", "left_semi")
    done = _settle(_cut(held, "_id").select("project", "_id", "parts"), config.known)
    if config.parts is not None:
        done = _fill(done, config.parts)
    if config.rings is not None:
        done = materialize(done, "values")
        while not done.filter(_is_open("ring")).isEmpty():
            nxt = materialize(_put(done, "ring", lambda opened: _around(opened, config.rings)), "values")
            drop(done)
            done = nxt
    done = done.select(F.col("project").alias("_project"), "_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("_done"))
    joined = rows.join(done, (rows["project"] == F.col("_project")) & (rows[column] == F.col("_id")), "left")
    return joined.withColumn(out, F.coalesce("_done", column)).drop("_project", "_id", "_done")

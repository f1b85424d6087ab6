"""Settings of many projects as rows (project, name, value), and the options that hold for each."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.model import RANGES, Options

EVERYWHERE = "*"  # the project that the settings of all projects are under
BLANK_ENDS = r"(?U)^\s+|\s+$"
LINES = r"[\r\n]+"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, BLANK_ENDS, "")


def items(value: Column, between: str = r"[,\r\n]+", distinct: bool = False) -> Column:
    """Items between commas and line ends, trimmed, without blanks."""
    found = F.filter(F.transform(F.split(value, between), trimmed), lambda x: x != "")
    return F.array_distinct(found) if distinct else found


def mappings(value: Column) -> Column:
    """A map of ``k=v`` lines; blank lines, comments and lines without both sides are left out, the last of a key holds."""
    lines = F.filter(items(value, LINES), lambda x: ~x.startswith("#") & (F.instr(x, "=") > 0))
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("k"), trimmed(x.substr(F.instr(x, "=") + 1, F.length(x))).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = lambda known, p: F.map_concat(F.map_filter(known, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), last)


def changed(a: Column, b: Column) -> Column:
    """Names of the settings that differ between two maps, lists compared item by item without blanks and repeats."""
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    at = lambda m, n: items(F.try_element_at(m, n), distinct=True)
    return F.filter(names, lambda n: ~at(a, n).eqNullSafe(at(b, n)))


def effective(settings: DataFrame) -> DataFrame:
    """(project, settings map) of each project: its own, or those of ``EVERYWHERE`` where its ``use_shared`` is true.

    Of a setting that is there more than once the greatest value holds. The one row of ``EVERYWHERE`` is broadcast, so the projects
    that share it, however many, don't meet in one task.
    """
    one = settings.groupBy("project", "name").agg(F.max("value").alias("value")).filter("name is not null")
    maps = one.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("settings"))
    shared = F.lower(F.try_element_at("settings", F.lit("use_shared"))) == "true"
    asked = maps.filter(F.col("project") != EVERYWHERE).withColumn("_from", F.when(shared, EVERYWHERE))
    everywhere = maps.filter(F.col("project") == EVERYWHERE).select(F.col("project").alias("_from"), F.col("settings").alias("_shared"))
    found = asked.join(F.broadcast(everywhere), "_from", "left")
    none = F.create_map().cast("map<string,string>")
    return found.select("project", F.when(F.col("_from").isNull(), F.col("settings")).otherwise(F.coalesce("_shared", none)).alias("settings"))


def options(settings: DataFrame) -> DataFrame:
    """(project, a column for each field of ``Options``): numbers within their ranges; what isn't set, or is no number, as by default."""
    out = {}
    for f in fields(Options):
        value, usual = F.try_element_at("settings", F.lit(f.name)), getattr(Options(), f.name)
        if isinstance(usual, bool):
            out[f.name] = F.coalesce(F.lower(trimmed(value)) == "true", F.lit(usual))
        elif isinstance(usual, int):
            number = F.coalesce(trimmed(value).try_cast("long"), F.lit(usual))
            low, high = RANGES[f.name]
            out[f.name] = F.least(F.greatest(number, F.lit(low)), F.lit(high)).cast("int")
        elif isinstance(usual, dict):
            out[f.name] = mappings(F.coalesce(value, F.lit("")))
        else:
            listed = items(value, LINES if f.name == "query_patterns" else r"[,\r\n]+")
            out[f.name] = F.coalesce(listed, F.array(*[F.lit(x) for x in usual]).cast("array<string>"))
    return effective(settings).select("project", *[c.alias(n) for n, c in out.items()])

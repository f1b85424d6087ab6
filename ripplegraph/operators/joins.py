"""Logical joins of the analysis: resolution, narrowing, topics, services and exactly-one matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ripplegraph.functions import text


def resolve(calls: DataFrame, methods: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(calls whose ``key`` is a method's ``target``, calls without one)."""
    keys = methods.select(F.col(target).alias(key)).distinct()
    return calls.join(keys, key, "left_semi"), calls.join(keys, key, "left_anti")


def narrow(candidates: DataFrame, by: list[str], named: Column, primary: Column) -> DataFrame:
    """Candidates of a call: those named if any is, else the only primary one, else all; a sole candidate stays."""
    w = W.partitionBy(*by)
    flagged = candidates.withColumns(
        {
            "_n": F.count("*").over(w),
            "_named": F.max(F.coalesce(named, F.lit(False)).cast("int")).over(w),
            "_primaries": F.sum(F.coalesce(primary, F.lit(False)).cast("int")).over(w),
        }
    )
    keep = (
        F.when(F.col("_n") == 1, F.lit(True))
        .when(F.col("_named") == 1, F.coalesce(named, F.lit(False)))
        .when(F.col("_primaries") == 1, F.coalesce(primary, F.lit(False)))
        .otherwise(F.lit(True))
    )
    return flagged.filter(keep).drop("_n", "_named", "_primaries")


def match_topics(produced: DataFrame, consumed: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of produced and consumed topics that mean the same: one equality of derived keys, not an OR of three."""
    a = produced.withColumn("_key", text.match_key(F.col(left)))
    b = consumed.withColumn("_key", text.match_key(F.col(right)))
    return a.join(b, "_key").drop("_key")


def first_mapping(services: DataFrame, mappings: DataFrame, service: str, key: str) -> DataFrame:
    """``target`` of the first of service, its key, and either without ``${}`` that (name, target) ``mappings`` know."""
    out = services
    tried = [F.col(service), F.col(key), text.unwrap(F.col(service)), text.unwrap(F.col(key))]
    for i, candidate in enumerate(tried):
        names = mappings.select(F.col("name").alias(f"_name{i}"), F.col("target").alias(f"_target{i}"))
        out = out.join(names, candidate == F.col(f"_name{i}"), "left")
    target = F.coalesce(*[F.col(f"_target{i}") for i in range(len(tried))]).alias("target")
    return out.select(*services.columns, target)


def lookup_project(wanted: DataFrame, projects: DataFrame, value: str) -> DataFrame:
    """``project`` whose name or base path is ``value``; of several the first by name (two equi-joins, no OR)."""
    named = projects.groupBy(F.col("name").alias("_by_name")).agg(F.min("name").alias("_n"))
    based = projects.groupBy(F.col("base_path").alias("_by_path")).agg(F.min("name").alias("_p"))
    out = wanted.join(named, F.col(value) == F.col("_by_name"), "left").join(based, F.col(value) == F.col("_by_path"), "left")
    return out.select(*wanted.columns, F.coalesce("_n", "_p").alias("project"))


def cardinality(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with ``matches``, how many rows of ``right`` it meets; counted before the join."""
    counts = right.groupBy(*on).agg(F.count("*").alias("_matches"))
    return left.join(counts, on, "left").withColumn("matches", F.coalesce("_matches", F.lit(0))).drop("_matches")


def status_of(matches: Column) -> Column:
    return F.when(matches == 0, "not_found").when(matches == 1, "ok").otherwise("ambiguous")


def latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Last writer wins: ``value`` of the greatest ``order`` for each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def enclosing(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, keep: str) -> DataFrame:
    """``points`` with ``keep`` of the innermost span of the same ``on`` around ``at``; null if there is none."""
    near = points.select(*on, at).distinct().join(spans.select(*on, start, end, keep), on).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = near.groupBy(*on, at).agg(F.max_by(keep, F.struct(F.col(start), -F.col(end))).alias(keep))
    return points.join(best, [*on, at], "left")

"""Resources: reclassification, distinct evidence, and merging on a confidence lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import text

MERGE_SEPARATOR = "\n---\n"


def reclassify(resources: DataFrame, rules: list[str]) -> DataFrame:
    """External HTTP resources whose name a rule matches become reads."""
    hit = (F.col("type") == "EXTERNAL_HTTP") & text.matches_any(F.col("name"), rules)
    return resources.withColumn("operation", F.when(hit, "READ").otherwise(F.col("operation")))


def drop_matching(resources: DataFrame, rules: list[str]) -> DataFrame:
    """Without the external HTTP resources whose name a rule matches."""
    return resources.filter(~((F.col("type") == "EXTERNAL_HTTP") & text.matches_any(F.col("name"), rules)))


def distinct_evidence(resources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (type, name, operation, confidence, detail), the first by ``ord``."""
    keys = [*by, "type", "name", "operation", "conf_rank", "detail"]
    rest = [c for c in resources.columns if c not in (*keys, "ord")]
    found = resources.groupBy(*keys).agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in rest])
    return found.select(*resources.columns)


def merge(resources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (type, name, operation): least certain confidence, all evidence in order, first source.

    Evidence is made distinct by an aggregate with map-side combine before any of it is gathered, so a row
    holds no more than what the report shows.
    """
    keys = [*by, "type", "name", "operation"]
    source = "source" in resources.columns
    first = [F.min(F.when(F.col("source").isNotNull(), F.struct("ord", "source"))).alias("_s")] if source else []
    once = resources.groupBy(*keys, "detail").agg(F.min("ord").alias("ord"), F.max("conf_rank").alias("conf_rank"), *first)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "detail"))), lambda x: x["detail"])
    aggregates = [F.min("ord").alias("ord"), F.max("conf_rank").alias("conf_rank"), F.array_join(ordered, MERGE_SEPARATOR).alias("detail")]
    if source:
        aggregates.append(F.min("_s")["source"].alias("source"))
    return once.groupBy(*keys).agg(*aggregates)


def distinct_edges(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each (caller, callee, reason), the first by ``ord``."""
    keys = [*by, "caller", "callee", "reason"]
    rest = [c for c in edges.columns if c not in (*keys, "ord")]
    return edges.groupBy(*keys).agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in rest])

"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the smallest node that it reaches.

    Each step halves the depth of what is left, and every table of links is written to the shared folder,
    so a lost executor costs one step at most. A node of many links is never gathered: its smallest
    neighbour comes from an aggregate, and the join that hands it on is one that Spark can split.
    """
    links = materialize(_tidy(links.select("a", "b")), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = materialize(_tidy(large), "large")
        # links now lead from a larger to a smaller node
        small = large.groupBy("a").agg(F.min("b").alias("_m"))
        nxt = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("l")).select("l.*")
        nxt = materialize(_tidy(nxt), "links")
        same = _print(nxt) == _print(links)
        drop(large)
        drop(links)
        links = nxt
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _print(links: DataFrame) -> tuple:
    """A fingerprint of a table of links, whatever their order."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import materialize, read

STEP = np.uint64(2862933555777941757)  # multiplier of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to ``shards`` - 1.

    Each key jumps forward over shard counts; only the last jump below ``shards`` counts, so one
    more shard moves just the keys whose next jump lands on it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    left = np.arange(len(state))
    at = np.zeros(len(state), np.int64)
    with np.errstate(over="ignore"):
        while len(left):
            out[left] = at
            state = state * STEP + np.uint64(1)
            nxt = np.floor((at + 1) * (2.0**31 / ((state >> np.uint64(33)).astype(np.float64) + 1.0)))
            go = nxt < shards
            left, state, at = left[go], state[go], nxt[go].astype(np.int64)
    return out.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """``jump`` as a column over a long key."""

    @F.arrow_udf(T.IntegerType())
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), shards))

    return of(key)


def shard_rows(rows: DataFrame, keys: list[str], shards: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of all rows with ``shard``, ``grown_shard`` and ``slot``.

    The keys and the shard count alone decide the shard (null keys hash like any other value, equal
    keys go together); ``grown_shard`` is the shard with one more shard. ``slot`` counts a shard's
    rows from 0 without gaps, repeated rows included. An empty table gives an empty table. Only the key, not the
    text, is hashed, whatever the text's length; other columns of any name don't matter, but ``keep`` can't hold
    the new columns' names or ones that begin with an underscore.

    Slots need no shard in one task: rows are numbered within (shard, input partition), a bounded
    group however large the shard, and each such group starts where those before it end.
    """
    key = F.xxhash64(*[F.col(k) for k in keys])
    digest = rows.select(*keep, key.alias("_key"))
    digest = digest.select(
        *keep,
        jump_shard(F.col("_key"), shards).alias("shard"),
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    digest = materialize(digest, "shards")
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = digest.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    starts = starts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("shard", "_part").orderBy("_pos")) - 1
    numbered = digest.withColumn("_place", place).join(starts, ["shard", "_part"])
    return numbered.select(*keep, "shard", "grown_shard", (F.col("_start") + F.col("_place")).cast("long").alias("slot"))


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards under law ``key``.

    Null text: size 16 and the crc32 of no bytes, 0. Null doc_id: a key like any other. Texts of any
    length are read once; only sizes and checksums travel.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(rows, ["doc_id"], 40, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

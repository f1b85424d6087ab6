"""From raw documents to packed training sequences: the stages of a corpus, one after another.

Rows may have null ids, texts and sources, texts of any length, ids and whole rows that are there again, and more columns
of any name but ones that begin with two underscores; all stages but the last return the columns that they get.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.common import drop, read, scratch, shared_folder
from ripplegraph.llm.langid import UNKNOWN, predicted
from ripplegraph.llm.mixing import mixed, words
from ripplegraph.llm.neardup import near_rows
from ripplegraph.llm.packing import pack
from ripplegraph.llm.toxicity import train, with_scores

#: SQL has no tokenizer, XXH64 or logistic fit; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
KEYS = ["__row", "__key"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or with no n-gram of any learned language, go."""
    return predicted(docs, docs.columns).filter((F.col("__lang") != UNKNOWN) & (F.col("__score") > 0)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return with_scores(docs, model, docs.columns).filter("__score < 0.7").select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEYS``, equal in rows that are equal in all columns; a doc_id may be null or repeated."""
    return docs.withColumn("__key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("__row", F.xxhash64(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the smallest doc_id, one without a doc_id only if all are.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Only rows of one group replace
    each other, whatever their doc_id; of rows that are equal in all columns one stays. The join and what follows it
    share one shuffle.
    """
    rows = keyed(docs)
    groups = near_rows(rows.withColumn("__none", F.col("doc_id").isNull()), "text", ["__none", *KEYS])
    first = groups.groupBy("component").agg(F.min(F.struct("__none", "__key", "__row")).alias("__first")).select(*[f"__first.{k}" for k in KEYS])
    return rows.join(first, KEYS, "left_semi").dropDuplicates(KEYS).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it doesn't take go, and those that it takes again are there again. Drawn by whole rows, not by doc_id."""
    taken = mixed(docs, F.array("source"), words(F.col("text")), docs.columns, docs.columns).filter("__copies > 0 and __size > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens."""
    return pack(docs, "text", ["doc_id"])


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next.

    What a stage wrote on its way is deleted when its result is written, and that when the next stage's is.
    """
    docs, folder, last = read(spark, sf_dir, "documents"), shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            drop(last)
        docs = last = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

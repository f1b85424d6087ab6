"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import read, small_batches


def token_counts(
    rows: DataFrame, text: str, keep: list[str], limit: int, json_name: str = "byte_bpe_50k.json", rank_name: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text; no shuffle.

    Which vocabulary strings encode alone as one token is proven before the first text (see ``bpe``).
    Pre-tokens among them count as one; only the others are merged, each once until a worker's bounded
    table of counts is full. Null text counts as empty: 0 bytes, 0 tokens. Long texts are read in parts, with
    the whole text's tokens. Rows keep their number, repeated ones included; an empty table gives an empty result.
    Other columns of any name don't matter, but ``keep`` can't hold the new columns' names.
    """
    schema = rows.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(batches):
        counter = encoder(False, json_name, rank_name)
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = [s for s, _ in counter.slices(texts)]
            tokens = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            columns = [batch.column(i) for i in range(len(keep))] + [n_bytes, pa.array(tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    small_batches(rows)
    counted = rows.select(*keep, F.col(text).alias("__text")).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``; limit 1024."""
    return token_counts(read(spark, sf_dir, "documents"), "text", ["doc_id"], 1024)

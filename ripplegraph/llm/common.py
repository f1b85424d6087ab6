"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ripplegraph.storage import drop, materialize, read, scratch, shared_folder

__all__ = ["byte_buffers", "caches", "column_as_float64", "crc_of_id", "drawn", "drop", "forget", "letters", "map_texts", "materialize", "numbered", "pieces", "read", "release_memory", "scratch", "shared_folder", "small_batches"]
BATCH_ROWS = 1000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def release_memory() -> None:
    """Give freed memory back to the system, which the C library otherwise keeps for the worker's next task."""
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


caches: list[dict] = []  # what this process keeps from task to task


def forget() -> None:
    """Drop what a worker keeps for other operators' tasks, which it may not see again."""
    if any(caches):
        for held in caches:
            held.clear()
        release_memory()


def small_batches(rows: DataFrame) -> None:
    """Lower the session's limit on the rows of an Arrow batch to ``BATCH_ROWS``, since a row may hold a long text."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(rows: DataFrame, text: str, keep: list[str], made: Callable[[pa.Array], list[pa.Array]], fields: str) -> DataFrame:
    """``keep`` columns and the columns ``fields`` that ``made`` gives for a batch of texts; no shuffle.

    Batches are kept small. A text that is kept anyway travels once.
    """
    small_batches(rows)
    at = keep.index(text) if text in keep else len(keep)
    sent = rows.select(*keep) if text in keep else rows.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*rows.select(*keep).schema.fields, *T._parse_datatype_string(fields).fields])

    def of(batches):
        forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made(batch.column(at))], names=schema.names)
        release_memory()

    return sent.mapInArrow(of, schema)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an integer id written as decimal text; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def drawn(hashed: Column, wanted: int, of: int) -> Column:
    """Whether a row belongs to a sample of about ``wanted`` rows ``of`` so many, by a hash; of any number some are drawn."""
    return F.pmod(hashed, F.lit(1 << 53)) < max(1, int(min(1.0, wanted / max(of, 1)) * (1 << 53)))


def numbered(rows: DataFrame, group: list[str], order: list[Column], place: str) -> DataFrame:
    """``rows`` with ``place``, which counts each group's rows from 0 in ``order``; no group meets in one task.

    Rows are sorted over ranges of (group, order) and written; a range's first place follows from the sizes of the ranges
    before it. Group columns hold no nulls. ``rows`` is read twice, so it should be a stored table.
    """
    by = [*[F.col(c) for c in group], *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    held = materialize(ranged.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sorted")
    ranges = held.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select(*group, "__range", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__at") - F.col("__first")
    return held.join(starts, [*group, "__range"]).withColumn(place, at.cast("long")).drop("__range", "__at", "__first", "__start")


def byte_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array, one after another, and where each row begins (nulls are empty)."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` units together (a larger row is a run by itself)."""
    runs, begin, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            runs.append((begin, i))
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        runs.append((begin, len(sizes)))
    return runs


def column_as_float64(array: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of equally long float lists without nulls as a matrix."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)

"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PART_ROWS = 200_000
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes within, once that is left: for work whose result is stored elsewhere."""
    held = _scratch.set([])
    try:
        yield
    finally:
        made = _scratch.get() or []
        _scratch.reset(held)
        for path in made:
            system, target = _file_system(spark, path)
            system.delete(target, True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster names it in ``spark.checkpoint.dir``; only a session that runs in one process gets one made where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ripplegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the columns ``by``, and read it back, which cuts its lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored = path
    return table


def bucketed(df: DataFrame, what: str, parts: int, *keys: str) -> DataFrame:
    """``materialize`` in so many buckets by keys, which are dealt out before this: joins on them shuffle the other side only.

    The catalog's name serves to write and to read the buckets; it is given up at once, the files stay.
    """
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    df.write.format("parquet").bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._stored = path
    spark.sql(f"DROP TABLE {name}")
    return table


def parts_of(df: DataFrame) -> int:
    """Partitions for ``df`` of some ``PART_ROWS`` rows each."""
    return -(-df.count() // PART_ROWS)


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt out by keys into so many partitions, so that what a task sorts doesn't grow with the table; a small one stays as it is."""
    return df.repartition(parts, *keys) if parts > 1 else df


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted."""
    system, target = _file_system(spark, pattern)
    return sorted(f.getPath().toString() for f in system.globStatus(target) or [])


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    found = getattr(df, "_stored", None)
    for path in [found] if found else {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        system, target = _file_system(df.sparkSession, path)
        system.delete(target, True)


def write_file(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One file with this content, wherever Spark can write."""
    system, target = _file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def write_text(lines: DataFrame, path: str, head: str) -> None:
    """One file of the ``line`` column, rows in their order, after ``head``; parts are written by tasks and then copied one after another.

    No line passes through Python or stays in the driver's memory.
    """
    spark = lines.sparkSession
    parts = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.select("line").write.text(parts)
    source, folder = _file_system(spark, parts)
    system, target = _file_system(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(f.getPath().getName() for f in source.listStatus(folder)):
            if name.startswith("part-"):
                part = source.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
    finally:
        out.close()
        source.delete(folder, True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, numbered from 0; each task reads its block of the file.

    A line's number is its place in its block after the lines of the blocks before; only the count of each block's lines is put in order.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    blocks = lines.groupBy("_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a task goes through a block in order
    before = blocks.select("_block", "_first", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    return lines.join(F.broadcast(before), "_block").select((F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "line")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Packing token sequences by linear grouping (de la Vega and Lueker, 1981) and best fit.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver. The plan made
there says, in runs, which sequences the first, second, ... piece of each length goes to; executors
number the pieces of each length and look their places up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .bpe import encoder
from .common import materialize, read, release_memory, small_batches

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class Plan:
    """Bins filled with runs: ``n`` pieces of one length into ``n`` sequences at one offset."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first piece, pieces, first sequence, offset
        self.used: dict[int, int] = defaultdict(int)  # pieces of a length placed so far
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, sequences)

    def new(self, n: int) -> tuple[int, int]:
        first = self.bins
        self.bins += n
        return first, n

    def put(self, length: int, n: int, first: int, room: int) -> None:
        self.runs.append((length, self.used[length], n, first, self.capacity - room))
        self.used[length] += n

    def leave(self, first: int, n: int, room: int) -> None:
        if n and room:
            self.open[room].append((first, n))

    def best_fit(self, length: int, n: int) -> None:
        """Place ``n`` pieces, each where it leaves the least room; open sequences when none has room."""
        for room in range(length, self.capacity + 1):
            while n and self.open.get(room):
                first, count = self.open[room].pop()
                k = min(n, count)
                self.leave(first + k, count - k, room)
                # more pieces may fit the same sequence, and none leaves less room than itself
                per = min(room // length, -(-n // k)) if k == count else 1
                left = room
                for _ in range(per):
                    m = min(n, k)
                    self.put(length, m, first, left)
                    self.leave(first + m, k - m, left)
                    n, k, left = n - m, m, left - length
                self.leave(first, k, left)
        per = self.capacity // length
        if n >= per:
            first, count = self.new(n // per)
            for i in range(per):
                self.put(length, count, first, self.capacity - i * length)
            self.leave(first, count, self.capacity - per * length)
            n -= per * count
        if n:
            first, _ = self.new(1)
            for i in range(n):
                self.put(length, 1, first, self.capacity - i * length)
            self.leave(first, 1, self.capacity - n * length)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Fractional numbers of bins by configuration that cover ``demand`` of few sizes: column generation."""
    m = len(sizes)
    columns = [np.where(np.arange(m) == j, capacity // sizes[j], 0).astype(float) for j in range(m)]
    inverse = np.diag([1.0 / c[j] for j, c in enumerate(columns)])
    x = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        worth = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            gain = worth[c - sizes[fits]] + price[fits]
            j = int(gain.argmax())
            worth[c], pick[c] = (gain[j], fits[j]) if gain[j] > worth[c - 1] + 1e-12 else (worth[c - 1], -1)
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        out = up[np.argmin(x[up] / step[up])]
        columns[out] = column
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        x = np.maximum(inverse @ demand, 0)
    return [(c, float(v)) for c, v in zip(columns, x, strict=True) if v > 1e-9]


def plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    """Linear grouping over lengths above ``small``, then best fit, largest first, for all that is left."""
    out = Plan(capacity)
    left = {int(s): int(n) for s, n in histogram.items() if n}
    if full := left.pop(capacity, 0):
        first, n = out.new(full)
        out.put(capacity, n, first, capacity)
    large = sorted((s for s in left if s > small), reverse=True)
    total = sum(left[s] for s in large)
    if total > groups:
        members: list[list[int]] = []  # lengths by group, largest first; a length is in one group
        seen = 0
        for s in large:
            if seen * groups >= len(members) * total:
                members.append([])
            members[-1].append(s)
            seen += left[s]
        sizes = np.array([g[0] for g in members])  # rounded up to the largest of the group
        demand = np.array([sum(left[s] for s in g) for g in members], float)
        rest = np.zeros(capacity + 1, np.int64)
        rest[large] = [left[s] for s in large]
        for column, bins in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            _substitute(out, members, rest, column.astype(int), int(bins))
    left = {s: left[s] - out.used[s] for s in left}
    for s in sorted(left, reverse=True):
        if left[s]:
            out.best_fit(s, left[s])
    return out


def _substitute(out: Plan, members: list[list[int]], rest: np.ndarray, column: np.ndarray, bins: int) -> None:
    """Fill ``bins`` copies of a configuration with actual pieces, largest first.

    Pieces are no longer than the sizes that they stand for; the last slot takes the longest piece left that
    fits what room there really is, so that rounding loses nothing where lengths are many.
    """
    slots = [j for j, n in enumerate(column) for _ in range(n)]
    if not slots:
        return
    bins = min([bins, *(int(rest[members[j]].sum()) // n for j, n in enumerate(column) if n)])
    if bins <= 0:
        return
    segments = [(*out.new(bins), out.capacity)]
    for i, j in enumerate(slots):
        nxt = []
        for first, n, room in segments:
            while n:
                if i + 1 < len(slots):
                    found = [s for s in members[j] if rest[s]][:1]
                else:
                    found = np.flatnonzero(rest[: room + 1])[-1:].tolist()
                if not found:
                    nxt.append((first, n, room))
                    break
                s = found[0]
                k = min(n, int(rest[s]))
                rest[s] -= k
                out.put(s, k, first, room)
                nxt.append((first, k, room - s))
                first, n = first + k, n - k
        segments = nxt
    for first, n, room in segments:
        out.leave(first, n, room)


def best_plan(histogram: dict[int, int], capacity: int, tries=((16, 256), (32, 256), (64, 256))) -> Plan:
    """The plan with the fewest sequences over a few (groups, small) settings of the scheme."""
    return min((plan(histogram, capacity, groups, small) for groups, small in tries), key=lambda p: p.bins)


def cut_pieces(rows: DataFrame, text: str, keep: list[str], capacity: int, end_id: int, json_name: str, rank_name: str) -> DataFrame:
    """``keep`` columns with each document's pieces: all of ``capacity`` ids, but the first may be shorter."""
    schema = T.StructType([*rows.select(*keep).schema.fields, *PIECES.fields])
    small_batches(rows)

    def cut(batches):
        coder = encoder(True, json_name, rank_name)
        for batch in batches:
            row = 0
            for sizes, flat in coder.slices(batch.column(len(keep))):
                at, found = 0, []
                for i, n in enumerate(sizes.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    start = 0
                    stop = (n + 1) % capacity or capacity
                    piece = 0
                    while start <= n:
                        found.append((row + i, piece, start, stop - start, zlib.crc32(ids[start:stop])))
                        piece, start, stop = piece + 1, stop, stop + capacity
                row += len(sizes)
                if found:
                    columns = list(zip(*found, strict=True))
                    kept = [batch.column(i).take(pa.array(columns[0])) for i in range(len(keep))]
                    made = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
        release_memory()

    return rows.select(*keep, F.col(text).alias("__text")).mapInArrow(cut, schema)


def pack(
    rows: DataFrame,
    text: str,
    keep: list[str],
    capacity: int = 1024,
    end_id: int = 2,
    json_name: str = "byte_bpe_50k.json",
    rank_name: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``.

    Null and empty texts make one piece, the end id alone. Longer texts than ``capacity`` ids are cut, all
    others stay whole. Repeated rows are packed each. An empty table gives an empty result. Pieces of a
    length are numbered within (length, input partition), so a common length isn't gathered in one task. Ids may be
    null; other columns of any name don't matter, but ``keep`` can't hold the new columns' names or ones that begin with an underscore.
    """
    cut = cut_pieces(rows, text, keep, capacity, end_id, json_name, rank_name)
    cut = cut.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    cut = materialize(cut, "pieces")
    by_part = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs = np.array(sorted(best_plan(histogram, capacity).runs) or [(0, 0, 0, 0, 0)], np.int64)
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("length", "_part").orderBy("_pos")) - 1
    numbered = cut.withColumn("_place", place).join(starts, ["length", "_part"])
    names = [*keep, *PIECES.names]
    numbered = numbered.select(*names, (F.col("_start") + F.col("_place")).cast("long").alias("_nth"))
    schema = T.StructType([*numbered.select(*names).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(runs)

    def place_all(batches):
        runs = shared.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_nth"))
            run = runs[np.searchsorted(keys, (length << 48) + nth, side="right") - 1]
            made = [pa.array(run[:, 3] + nth - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=schema.names)

    return numbered.mapInArrow(place_all, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"), "text", ["doc_id"])

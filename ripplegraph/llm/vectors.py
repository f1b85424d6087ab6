"""Nearest neighbours: an inverted multi-index (approximate) and segment statistics (exact).

Both deal the vectors in cells and the cells in blocks, and send a query only to the blocks of cells that it visits. A block
is read by as many tasks as its queries need, so what is copied follows the visits, not the product of both sides.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import column_as_float64, drawn, materialize, read

LARGEST, SMALLEST, BLOCKS = 8192, 1024, 64  # candidates of a block: most, least, and how many blocks small tables have
QUERIES = 4096  # queries that a task holds at once
TOGETHER = 256  # of which so many are scored at once
SAMPLE = 50_000  # vectors that an index is fitted on, about
CELL = 50  # vectors in a cell, about, until there are MOST_CODES a half
MOST_CODES = 256
RECALL = 0.99  # of the sample's own neighbours, from which the part of all vectors that a query visits is set
SEEDS = 4096  # sample vectors from which a query's first threshold comes


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False))


def usable(rows: DataFrame, zero: bool) -> tuple[DataFrame, list[int]]:
    """(id, v) that take part, and the widths that occur; vectors meet only those of their own width."""
    good = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = good.filter(F.col("id").isNotNull() & finite(F.col("v")))
    if not zero:
        good = good.filter(F.exists("v", lambda x: x != 0))
    return good, sorted(r["w"] for r in good.select(F.size("v").alias("w")).distinct().collect())


def by_width(rows: DataFrame, zero: bool, search, result: str) -> DataFrame:
    """``search`` (vectors, width) of the vectors of each width."""
    good, widths = usable(rows, zero)
    found = [search(good.filter(F.size("v") == w), w) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], result)


def is_query(column: str) -> Column:
    return F.col(column) % 50 == 0


def sampled(good: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about ``SAMPLE`` vectors by a hash of the id."""
    some = good.filter(drawn(F.xxhash64("id"), SAMPLE, n)).orderBy(F.xxhash64("id", F.lit(7)), "id", "v").limit(2 * SAMPLE).toArrow()
    if not some.num_rows:
        some = good.orderBy("id", "v").limit(1000).toArrow()
    return some.column("id").to_numpy(), column_as_float64(some.column("v"), width)


def blocks_of(sizes: dict[int, int], n: int) -> tuple[dict[int, int], dict[int, int]]:
    """(first block, blocks) of each cell: small cells share a block, large ones are dealt over several."""
    most = min(LARGEST, max(SMALLEST, -(-n // BLOCKS)))
    first, splits, block, filled = {}, {}, 0, 0
    for cell in sorted(sizes):
        if filled and filled + sizes[cell] > most:
            block, filled = block + 1, 0
        splits[cell] = -(-sizes[cell] // most)
        first[cell] = block
        filled += sizes[cell]
        if splits[cell] > 1:
            block, filled = block + splits[cell], 0
    return first, splits


def met(asked: DataFrame, stored: DataFrame, plan: tuple[dict, dict], search, score: str, k: int) -> DataFrame:
    """The ``k`` best of each query row: ``asked`` (q, id, v, _block, ...) meets the ``stored`` (id, v, cell) of its blocks in ``search``."""
    spark = stored.sparkSession
    first, splits = plan
    asked = materialize(asked, "asked")
    chunks = asked.groupBy("_block").agg(F.ceil(F.count("*") / QUERIES).alias("_chunks"))
    asked = asked.join(chunks, "_block").withColumn("_chunk", F.pmod(F.xxhash64("q", F.lit(3)), F.col("_chunks")))
    cells = spark.createDataFrame([(c, first[c], splits[c]) for c in first], "cell long, _first long, _splits long")
    entries = stored.join(cells, "cell").withColumn("_block", F.col("_first") + F.pmod(F.xxhash64("id", F.lit(11)), F.col("_splits")))
    entries = entries.join(chunks, "_block").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    entries = entries.select("id", "v", "cell", "_block", "_chunk")
    kind = "double" if score == "double" else "long"
    found = asked.groupBy("_block", "_chunk").cogroup(entries.groupBy("_block", "_chunk")).applyInArrow(search, f"q long, query_id long, vec_id long, score {kind}")
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries_of(stored: DataFrame) -> DataFrame:
    """(q, id, v) of the rows that ask; ``q`` tells apart rows of one id."""
    return materialize(stored.filter(is_query("id")).select(F.monotonically_increasing_id().alias("q"), "id", "v"), "queries")


def table(found: list[tuple], kind: pa.DataType) -> pa.Table:
    """(q, query_id, vec_id, score) from parts of such columns."""
    types = (pa.int64(), pa.int64(), pa.int64(), kind)
    columns = list(zip(*found, strict=True)) or [[]] * 4
    return pa.table({n: pa.concat_arrays([pa.array(x, t) for x in c] or [pa.array([], t)]) for n, c, t in zip(("q", "query_id", "vec_id", "score"), columns, types, strict=True)})


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` best scores above -inf, ties to smaller ids."""
    rows, columns = [], []
    for i, r in enumerate(scores):
        near = np.flatnonzero(r > -np.inf) if len(r) <= k else np.flatnonzero((r >= np.partition(r, len(r) - k)[len(r) - k]) & (r > -np.inf))
        near = near[np.lexsort((ids[near], -r[near]))][:k]
        rows.append(np.full(len(near), i))
        columns.append(near)
    return np.concatenate(rows), np.concatenate(columns)


# ---- inverted multi-index --------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; begins with rows spread over the sample, empty clusters keep their place."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


class MultiIndex:
    """Codebooks of both vector halves and how many different vectors each of the pairs of codes holds."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        codes = max(1, min(codes, len(sample)))
        self.books = [kmeans(x, codes) if x.shape[1] else np.zeros((1, 0)) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.k = len(self.books[1])
        self.sizes = np.zeros(len(self.books[0]) * self.k, np.int64)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its centroids, less a constant."""
        return [(b**2).sum(1) - 2 * h @ b.T for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.distances(x))
        return a * self.k + b

    def traverse(self, a: np.ndarray, b: np.ndarray, wanted: int) -> list[int]:
        """Cells by summed distance, nearest first, until they hold ``wanted`` vectors: the multi-sequence algorithm."""
        ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        da, db = a[ia].tolist(), b[ib].tolist()
        heap = [(da[0] + db[0], 0, 0)]
        done = [0] * len(ia)  # of each row of pairs, how many have been taken
        out, held = [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            done[i] = j + 1
            cell = ia[i] * self.k + ib[j]
            if self.sizes[cell]:
                out.append(cell)
                held += int(self.sizes[cell])
            if i + 1 < len(ia) and done[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            if j + 1 < len(ib) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, safe for components of any size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def share_of(index: MultiIndex, x: np.ndarray, recall: float, k: int, queries: int = 500) -> float:
    """Part of all different vectors that a query has to visit so that ``recall`` of the sample's true neighbours are met."""
    x = np.unique(x, axis=0)
    if len(x) < 2:
        return 1.0
    asks = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    cells = index.cells(x)
    index.sizes[:] = np.bincount(cells, minlength=len(index.sizes))
    a, b = index.distances(x[asks])
    places = []
    for i, q in enumerate(asks.tolist()):
        s = x @ x[q]
        s[q] = -np.inf
        true = np.argpartition(-s, min(k, len(s) - 1) - 1)[: min(k, len(x) - 1)]
        order = np.array(index.traverse(a[i], b[i], len(x)))
        before = np.zeros(len(index.sizes))
        before[order] = np.cumsum(index.sizes[order]) - index.sizes[order]
        places.append(before[cells[true]] + 1)
    return float(min(1.0, np.quantile(np.concatenate(places), recall, method="higher") / len(x)))


def cosine_search(rows: DataFrame, k: int = 5, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` most cosine-similar found for each query row.

    The index is fitted on a sample of about ``SAMPLE`` vectors by a hash of the id and holds all vectors. A
    query visits cells, nearest first, until they hold the part of all different vectors that gave ``recall`` on the
    sample, so copies of one vector take the place of no other. Vectors meet only those of their own width. Every
    row that asks has its own ranks, repeated rows too; all rows of its vec_id count as its own. Ties go to the
    smaller vec_id; a candidate row that is there twice is found twice. An empty table gives an empty result.
    """
    return by_width(rows, False, lambda good, width: _cosine(good, width, k, recall, cell), "query_id long, rank int, vec_id long, score double")


def _cosine(good: DataFrame, width: int, k: int, recall: float, cell: int) -> DataFrame:
    spark = good.sparkSession
    n = good.count()
    sample = unit(sampled(good, n, width)[1])
    index = MultiIndex(sample, min(MOST_CODES, max(1, int((n / cell) ** 0.5))))
    share = share_of(index, sample, recall, k)
    fitted = spark.sparkContext.broadcast(index)

    def to_cells(batches):
        for batch in batches:
            if batch.num_rows:
                cells = fitted.value.cells(unit(column_as_float64(batch.column(1), width)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells)], names=["id", "v", "cell"])

    stored = materialize(good.mapInArrow(to_cells, "id long, v array<double>, cell long"), "cells")
    by_cell = stored.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("v")).alias("d")).collect()  # MOST_CODES squared at most
    index.sizes[:] = 0
    for r in by_cell:
        index.sizes[r["cell"]] = r["d"]
    plan = blocks_of({r["cell"]: r["n"] for r in by_cell}, n)
    wanted = int(np.ceil(share * index.sizes.sum()))
    known = spark.sparkContext.broadcast((index, *plan))

    def visit(batches):
        index, first, splits = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = index.distances(unit(column_as_float64(batch.column(2), width)))
            row, blocks, lists = [], [], []
            for i in range(batch.num_rows):
                here: dict[int, list[int]] = {}
                for c in index.traverse(a[i], b[i], wanted):
                    for s in range(splits[c]):
                        here.setdefault(first[c] + s, []).append(c)
                row.extend([i] * len(here))
                blocks.extend(here)
                lists.extend(here.values())
            took = pa.array(row, pa.int64())
            columns = [batch.column(i).take(took) for i in range(3)] + [pa.array(blocks, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "id", "v", "_block", "cells"])

    asked = queries_of(stored).mapInArrow(visit, "q long, id long, v array<double>, _block long, cells array<long>")

    def search(q: pa.Table, e: pa.Table) -> pa.Table:
        found = []
        if e.num_rows and q.num_rows:
            order = np.argsort(e.column("cell").to_numpy(), kind="stable")
            ids, cells = e.column("id").to_numpy()[order], e.column("cell").to_numpy()[order]
            uy = unit(column_as_float64(e.column("v"), width)[order])
            for at in range(0, q.num_rows, TOGETHER):
                some = q.slice(at, TOGETHER)
                rows, qids = some.column("q").to_numpy(), some.column("id").to_numpy()
                ux = unit(column_as_float64(some.column("v"), width))
                out = np.ones((len(rows), len(ids)), bool)
                for i, visited in enumerate(some.column("cells").to_pylist()):
                    for c in visited:
                        out[i, np.searchsorted(cells, c) : np.searchsorted(cells, c, side="right")] = False
                rough = np.where(out | (qids[:, None] == ids), -np.inf, ux @ uy.T)
                # products of matrices are rounded by place: what could be among the best is scored again, alike for equal vectors
                least = np.sort(rough, axis=1)[:, max(len(ids) - k, 0)] - 1e-12
                qi, ci = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
                exact = np.full(rough.shape, -np.inf)
                for s in range(0, len(qi), 8192):
                    exact[qi[s : s + 8192], ci[s : s + 8192]] = (ux[qi[s : s + 8192]] * uy[ci[s : s + 8192]]).sum(axis=1)
                i, j = best_rows(exact, ids, k)
                found.append((rows[i], qids[i], ids[j], exact[i, j]))
        return table(found, pa.float64())

    return met(asked, stored, plan, search, "double", k)


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th of ``embeddings`` by cosine."""
    return cosine_search(read(spark, sf_dir, "embeddings"))


# ---- exact search by segment statistics ------------------------------------------------------------


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of ``segments`` runs of each row, both times the square root of the run's length.

    With them, the product of two rows is at most (means . means) + (deviations . deviations), by Cauchy and Schwarz
    in each run; equivalently their distance is at least what those differ by.
    """
    cut = np.linspace(0, x.shape[1], segments + 1).astype(int)
    means, devs = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = x[:, a:b]
        m = part.mean(axis=1)
        means.append(m * np.sqrt(b - a))
        devs.append(np.sqrt(((part - m[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, axis=1), np.stack(devs, axis=1)


def levels(width: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return [s for s in (1, 4, 8, 16) if s < width] or [1]


def product_search(rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest integer inner products of floor(256 x), exactly.

    Vectors are dealt in cells by their mean. The statistics of a cell, the range of its means and its greatest
    deviations by segment, bound the products with all that it holds, and a query visits only the cells that can reach the
    ``k`` best products that it has with a sample. There, bounds from the vectors' own means and deviations, from coarse to
    fine, leave out more; the products of all others are computed. Products beyond a long are taken as the greatest or
    least long, and tie there. Widths, repeated rows, ties and empty tables are as in ``cosine_search``.
    """
    return by_width(rows, True, lambda good, width: _products(good, width, k), "query_id long, rank int, vec_id long, score long")


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), components beyond a double taken as the greatest double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * x), -np.finfo(float).max, np.finfo(float).max)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All integer inner products of rows of ``x`` and ``y``, within a long."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if top < 2.0**53:
        return np.rint(x @ y.T).astype(np.int64)
    xi, yi = ([[int(v) for v in row] for row in m.tolist()] for m in (x, y))  # doubles don't hold these exactly
    least, most = -(2**63), 2**63 - 1
    return np.array([[min(max(sum(a * b for a, b in zip(p, q, strict=True)), least), most) for q in yi] for p in xi], np.int64).reshape(len(xi), len(yi))


def _products(good: DataFrame, width: int, k: int) -> DataFrame:
    spark = good.sparkSession
    n = good.count()
    ids, sample = sampled(good, n, width)
    sample = whole(sample)
    bins = max(1, -(-n // min(LARGEST, max(SMALLEST, -(-n // BLOCKS)))))
    edges = np.unique(np.quantile(sample.mean(axis=1), np.linspace(0, 1, bins + 1)[1:-1])) if bins > 1 else np.zeros(0)
    seeds = spark.sparkContext.broadcast((ids[:SEEDS], sample[:SEEDS]))
    coarse = [s for s in levels(width) if s <= 8][-1]

    def to_cells(batches):
        for batch in batches:
            if batch.num_rows:
                z = whole(column_as_float64(batch.column(1), width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * width), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.searchsorted(edges, z.mean(axis=1)))], names=["id", "v", "cell"])

    def spans(batches):
        for batch in batches:
            cells = batch.column(1).to_numpy()
            if len(cells):
                means, devs = statistics(column_as_float64(batch.column(0), width), coarse)
                for c in np.unique(cells):
                    mine = cells == c
                    low, high, far = means[mine].min(axis=0), means[mine].max(axis=0), devs[mine].max(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(coarse, c), np.arange(coarse), low, high, far, np.full(coarse, mine.sum()))], names=["cell", "s", "low", "high", "far", "n"])

    stored = materialize(good.mapInArrow(to_cells, "id long, v array<double>, cell long"), "cells")
    spanned = stored.select("v", "cell").mapInArrow(spans, "cell long, s long, low double, high double, far double, n long")
    spanned = spanned.groupBy("cell", "s").agg(F.min("low"), F.max("high"), F.max("far"), F.sum("n")).orderBy("cell", "s").collect()  # a few rows a block
    cells = np.array([r["cell"] for r in spanned[::coarse]], np.int64)
    low, high, far = (np.array([r[i] for r in spanned], float).reshape(-1, coarse) for i in (2, 3, 4))
    plan = blocks_of({r["cell"]: r[5] for r in spanned[::coarse]}, n)
    known = spark.sparkContext.broadcast((cells, low, high, far, *plan))

    def visit(batches):
        cells, low, high, far, first, splits = known.value
        sids, sample = seeds.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z, own = column_as_float64(batch.column(2), width), batch.column(1).to_numpy()
            row, blocks, least = [], [], []
            for at in range(0, len(z), TOGETHER):
                x, mine = z[at : at + TOGETHER], own[at : at + TOGETHER]
                with np.errstate(all="ignore"):
                    s = np.where(mine[:, None] == sids, -np.inf, x @ sample.T)
                    best = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), -np.inf)
                    best = np.where(np.isfinite(best) & (best > -(2.0**63)), np.minimum(best, 2.0**63), -np.inf)  # beyond a long they tie
                    best = best - np.where(np.isfinite(best), 1e-9 * (1 + np.abs(best)), 0)
                    means, devs = statistics(x, coarse)
                    bound = np.maximum(means, 0) @ high.T + np.minimum(means, 0) @ low.T + devs @ far.T
                    on = ~(bound + 1e-9 * (1 + np.abs(bound)) < best[:, None])
                for i in range(len(x)):
                    here = {first[c] + s for c in cells[on[i]].tolist() for s in range(splits[c])}
                    row.extend([at + i] * len(here))
                    blocks.extend(sorted(here))
                    least.extend([best[i]] * len(here))
            took = pa.array(row, pa.int64())
            columns = [batch.column(i).take(took) for i in range(3)] + [pa.array(blocks, pa.int64()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "id", "v", "_block", "least"])

    asked = queries_of(stored).mapInArrow(visit, "q long, id long, v array<double>, _block long, least double")

    def search(q: pa.Table, e: pa.Table) -> pa.Table:
        found = []
        if e.num_rows and q.num_rows:
            ids, y = e.column("id").to_numpy(), column_as_float64(e.column("v"), width)
            tables = [statistics(y, s) for s in levels(width)]
            for at in range(0, q.num_rows, TOGETHER):
                some = q.slice(at, TOGETHER)
                rows, qids, x = some.column("q").to_numpy(), some.column("id").to_numpy(), column_as_float64(some.column("v"), width)
                alive, best = qids[:, None] != ids, some.column("least").to_numpy().copy()
                columns = np.arange(len(ids))
                with np.errstate(all="ignore"):
                    for (means, devs), s in zip(tables, levels(width), strict=True):
                        qm, qd = statistics(x, s)
                        bound = qm @ means[columns].T + qd @ devs[columns].T
                        alive &= ~(bound + 1e-9 * (1 + np.abs(bound)) < best[:, None])
                        columns, alive = columns[alive.any(axis=0)], alive[:, alive.any(axis=0)]
                if not len(columns):
                    continue
                score = products(x, y[columns])
                exact = np.abs(score).max(initial=0) < 2**53
                for i in range(len(rows)):
                    on = np.flatnonzero(alive[i])
                    if exact and len(on) > k:
                        on = on[score[i, on] >= np.partition(score[i, on], len(on) - k)[len(on) - k]]
                    on = on[np.lexsort((ids[columns[on]], -(score[i, on].astype(object)) if not exact else -score[i, on]))][:k]
                    found.append((np.full(len(on), rows[i]), np.full(len(on), qids[i]), ids[columns[on]], score[i, on]))
        return table(found, pa.int64())

    return met(asked, stored, plan, search, "long", k)


def op9_segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th of ``embeddings``."""
    return product_search(read(spark, sf_dir, "embeddings"))


#: The same rows by comparing all pairs.
OP9_SQL = """
WITH z AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM z q JOIN z c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

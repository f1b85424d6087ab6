"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). Each pattern can send its
words to any of its sources once at no cost, again at a cost, and a third time at a higher one; each source
takes up to its target. The cheapest flow says how many words of each pattern the mix takes; seeded
documents then make that number up. Only sums by pattern reach the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, read

WORD = r"[^\x20\x09-\x0D]+"
RANGE = 12  # bits of the hash that one step of the search for a pattern's edge takes
ORDERED = 10_000  # different hashes of a pattern that are put in order


def capped_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of all words by weight, none above ``most`` times its source; the excess goes to the others by weight."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    left, amount = set(range(len(sizes))), total
    while left:
        weight = sum(weights[i] for i in left)
        over = [i for i in left if amount * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = amount * weights[i] / weight
            break
        for i in over:
            out[i] = most * float(sizes[i])
            left.discard(i)
        amount = total - sum(out[i] for i in range(len(out)) if i not in left)
    return out


def cheapest_flow(sizes: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources: successive shortest paths with potentials.

    The copy of rank r of a pattern costs r squared a word, so the costs are convex and no pattern is
    repeated while another with room could serve its sources.
    """
    patterns, sources = list(sizes), list(targets)
    at = {s: i for i, s in enumerate(sources)}
    n = 2 + len(patterns) + len(sources)
    arcs: list[list] = []  # to, room, cost
    out_of: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out_of[a].append(len(arcs))
        arcs.append([b, room, cost])
        out_of[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    place = 2 + len(patterns)
    for i, p in enumerate(patterns):
        for r in range(repeats):
            arc(0, 2 + i, sizes[p], r * r)
    mid = len(arcs)
    routes = []
    for i, p in enumerate(patterns):
        for s in p:
            routes.append((p, s, len(arcs)))
            arc(2 + i, place + at[s], repeats * sizes[p], 0)
    for s in sources:
        arc(place + at[s], 1, int(round(targets[s])), 0)
    assert mid % 2 == 0
    potential = [0] * n
    while True:
        far, by = [None] * n, [-1] * n
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k in out_of[u]:
                v, room, cost = arcs[k]
                if room and (far[v] is None or d + cost + potential[u] - potential[v] < far[v]):
                    far[v], by[v] = d + cost + potential[u] - potential[v], k
                    heapq.heappush(heap, (far[v], v))
        if far[1] is None:
            break
        top = max(x for x in far if x is not None)
        for i in range(n):
            potential[i] += top if far[i] is None else far[i]
        v, room = 1, None
        while v:
            k = by[v]
            room = arcs[k][1] if room is None else min(room, arcs[k][1])
            v = arcs[k ^ 1][0]
        v = 1
        while v:
            arcs[by[v]][1] -= room
            arcs[by[v] ^ 1][1] += room
            v = arcs[by[v] ^ 1][0]
    flow: dict[tuple, dict] = defaultdict(dict)
    for p, s, k in routes:
        flow[p][s] = arcs[k ^ 1][1]
    return flow


def route(sizes: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple, dict]:
    """``cheapest_flow`` for each group of patterns that share sources, however indirectly."""
    head = {s: s for s in targets}

    def find(s):
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for p in sizes:
        for s in p[1:]:
            head[find(s)] = find(p[0])
    groups: dict = defaultdict(lambda: ({}, {}))
    for p, n in sizes.items():
        if p:
            groups[find(p[0])][0][p] = n
    for s, t in targets.items():
        groups[find(s)][1][s] = t
    out: dict[tuple, dict] = {}
    for some, wanted in groups.values():
        out |= cheapest_flow(some, wanted, repeats)
    return out


def mixed(docs: DataFrame, sources: Column, size: Column, keep: list[str], by: list[str], repeats: int = 3, seed: int = 17) -> DataFrame:
    """``keep`` columns with ``__size``, ``__source_size``, ``__target`` and ``__copies``, how often the mix takes the row.

    The draw is a threshold on a seeded hash of the columns ``by``. Sums over ranges of the hash find the range in which
    a pattern's words are reached, then the ranges within that one, until few rows are left to be put in order. One
    document more closes the gap. Of rows equal in ``by`` as many are taken as there is room for. Texts are read
    twice, and never shuffled but for equal rows of which a part is taken.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    spelled = F.transform("__p", lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("0")))
    made = docs.select(*keep, names.alias("__p"), size.cast("long").alias("__size"), F.xxhash64(*[F.col(c) for c in by], F.lit(seed)).alias("__h"))
    made = made.withColumn("__k", F.xxhash64(F.array_join(spelled, "\u0001")))
    digest = materialize(made.select("__p", "__k", "__size", "__h"), "mix")
    sums = digest.groupBy("__k", "__p").agg(F.sum("__size").alias("n")).collect()  # a row a pattern
    sizes = {tuple(r["__p"]): r["n"] for r in sums}
    order = sorted({s for p in sizes for s in p}, key=lambda s: (s is None, s))
    own: dict = defaultdict(int)
    base: dict = defaultdict(int)  # a word in two sources counts for the first of them only in what is shared out
    for p, n in sizes.items():
        base[p[0]] += n
        for s in p:
            own[s] += n
    weights = [1.0 + i % 3 for i in range(len(order))]
    shared = [own[s] for s in order] if sum(own.values()) == sum(sizes.values()) else [base[s] for s in order]
    targets = dict(zip(order, capped_targets(shared, weights, repeats), strict=True))
    flow = route(sizes, targets, repeats)
    plan = []
    for r in sums:
        p, n = tuple(r["__p"]), r["n"]
        wanted = sum(flow.get(p, {}).values())
        copies = min(wanted // n, repeats) if n else 0
        plan.append((r["__k"], own[p[0]], float(targets[p[0]]), int(copies), int(wanted - copies * n)))
    schema = "__k long, __source_size long, __target double, __whole long, __more long"
    rows = materialize(spark.createDataFrame(plan, schema), "mix-plan")
    some = materialize(_partly(digest, rows), "mix-edges")
    out = made.join(rows.drop("__more"), "__k").join(some.select("__k", "__edge").distinct(), "__k", "left")
    out = out.withColumn("__copies", F.col("__whole") + F.coalesce(F.col("__h") < F.col("__edge"), F.lit(False)).cast("long"))
    parts = some.select("__k", F.explode("__items").alias("i")).select("__k", "i.*").select("__k", F.col("h").alias("__h"), "q", "m")
    out = out.join(parts, ["__k", "__h"], "left")
    columns = [*keep, "__size", "__source_size", "__target"]
    done = out.filter("q is null or q = m").select(*columns, (F.col("__copies") + F.when(F.col("q").isNotNull(), 1).otherwise(0)).alias("__copies"))
    if parts.filter("q < m").isEmpty():
        return done
    split = out.filter("q < m").withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()})
    split = materialize(split, "mix-equal")
    before = W.partitionBy("__k", "__h").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = split.groupBy("__k", "__h", "__part").agg(F.count("*").alias("__n"))
    starts = starts.select("__k", "__h", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(W.partitionBy("__k", "__h", "__part").orderBy("__pos"))
    split = split.withColumn("__place", place).join(starts, ["__k", "__h", "__part"])
    taken = (F.col("__start") + F.col("__place") <= F.col("q")).cast("long")
    return done.unionByName(split.select(*columns, (F.col("__copies") + taken).alias("__copies")))


def _partly(digest: DataFrame, rows: DataFrame) -> DataFrame:
    """(__k, __edge, __items) of each pattern of which a part is taken: rows whose hash is below the edge, and q of the m rows of each item's hash."""
    sized = digest.filter("__size > 0").select("__k", "__h", "__size")
    here = rows.filter("__more > 0").select("__k", "__more", F.lit(0).cast("long").alias("__before"), F.lit(None).cast("long").alias("__range"))
    bits = 64
    while True:
        inside = sized.join(here, "__k").filter(F.col("__range").isNull() | (F.shiftright("__h", bits) == F.col("__range")) if bits < 64 else F.lit(True))
        most = inside.groupBy("__k").agg(F.approx_count_distinct("__h").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= ORDERED or bits <= RANGE:
            break
        bits -= RANGE
        by_range = inside.groupBy("__k", "__more", "__before", F.shiftright("__h", bits).alias("_range")).agg(F.sum("__size").alias("_n"))
        here = materialize(_edge(by_range, "_range").select("__k", "__more", F.col("_before").alias("__before"), F.col("_range").alias("__range")), "mix-ranges")
    items = inside.groupBy("__k", "__more", "__before", "__h").agg(F.sum("__size").alias("_n"), F.count("*").alias("m"), F.min("__size").alias("z"))
    edge = _edge(items, "__h").withColumn("q", F.least("m", F.floor((F.col("__more") - F.col("_before")) / F.col("z"))))
    edge = edge.select("__k", F.col("__h").alias("__edge"), "q", "m", (F.col("__more") - F.col("_before") - F.col("q") * F.col("z")).alias("_gap"))
    edge = materialize(edge, "mix-edge")
    off = F.abs(F.col("__size") - F.col("_gap"))
    left = sized.join(edge.filter("_gap > 0"), "__k").filter((F.col("__h") > F.col("__edge")) | ((F.col("__h") == F.col("__edge")) & (F.col("q") < F.col("m"))))
    spare = left.filter(off < F.col("_gap")).groupBy("__k").agg(F.min(F.struct(off.alias("off"), F.col("__h").alias("h"))).alias("s")).select("__k", F.col("s.h").alias("h"))
    spare = sized.join(spare, "__k").filter(F.col("__h") == F.col("h")).groupBy("__k", "h").agg(F.count("*").alias("m2"))
    both = edge.join(spare, "__k", "left")
    item = lambda h, q, m: F.struct(F.col(h).alias("h"), q.cast("long").alias("q"), F.col(m).cast("long").alias("m"))
    more = F.col("q") + (F.col("h") == F.col("__edge")).cast("long")
    items = F.when(F.col("h").isNull(), F.array(item("__edge", F.col("q"), "m"))).when(F.col("h") == F.col("__edge"), F.array(item("__edge", more, "m")))
    items = items.otherwise(F.array(item("__edge", F.col("q"), "m"), item("h", F.lit(1), "m2")))
    return both.select("__k", "__edge", items.alias("__items"))


def _edge(sums: DataFrame, by: str) -> DataFrame:
    """Of each pattern's sums ``_n`` in the order of ``by`` that one in which ``__more`` words are reached, with what comes ``_before``."""
    before = W.partitionBy("__k").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    reached = sums.withColumn("_before", F.col("__before") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return reached.filter((F.col("_before") < F.col("__more")) & (F.col("__more") <= F.col("_before") + F.col("_n")))


def mix(docs: DataFrame, sources: Column, size: Column, keep: list[str], by: list[str] | None = None, repeats: int = 3) -> DataFrame:
    """``keep`` columns with ``size``, ``source_size``, ``target`` and ``taken``; drawn by the columns ``by``, or else ``keep``.

    ``sources`` is an array of source names (an empty one counts as the source null; null names come last).
    Weights are 1, 2, 3, repeating, by code point. ``taken`` is a whole number of copies, at most ``repeats``.
    ``source_size`` and ``target`` are those of the document's first source. Repeated rows are taken one by one, null
    ids like any other. Documents without words take nothing; texts are counted whole; an empty table gives an
    empty result. Other columns of any name don't matter, but names that begin with two underscores are
    reserved. The driver holds a row for each pattern.
    """
    out = mixed(docs, sources, size, keep, by or keep, repeats)
    taken = (F.col("__copies") * F.col("__size")).alias("taken")
    return out.select(*keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken)


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 1, 2, 3 by source."""
    docs = read(spark, sf_dir, "documents")
    return mix(docs, F.array("source"), words(F.col("text")), ["doc_id"], by=["doc_id", "source", "text"])

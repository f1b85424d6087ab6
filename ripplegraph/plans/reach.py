"""Recursive plans: reachability by frontier, bounded path enumeration, closures.

Reachability runs level by level. Each level joins the frontier of all roots at once to the edges, keeps one
winning row for each (root, node), and drops what has been visited by an anti join. Only nodes that can be met again and lead on
are looked up there, from level ``SHALLOW`` on: they are a folder of their own in each level's table, so the rest of former levels isn't read again. Edges are put together once; more
than one part of them is stored in buckets by src, so that a level shuffles its frontier and not all edges again. Levels
are written to the shared folder, and every ``COMPACT`` of them become one table, so the plan of a level never
grows beyond that and a lost executor costs one level. Tables that nothing reads any more are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ripplegraph.storage import bucketed, dealt, drop, materialize, parts_of

COMPACT = 12  # levels that become one table
SHALLOW = 6  # levels from which it pays to know which nodes must be remembered
INFERRED_MARK = " [推断分支]"


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = 30, with_path: bool = False) -> DataFrame:
    """(root, node, depth, conf[, path]) of every node that a root reaches within ``max_depth`` steps (None: any number), itself included.

    ``edges`` has src, dst and conf (0 confirmed, 1 inferred, 2 unresolved), and may have a label that a path
    shows instead of dst. ``roots`` has root and node, and may begin with a depth, conf and path of its own. A
    node's row is the one of least depth, then of the most certain path, then of the first path; a path is
    as certain as its least certain edge. Cycles end because visited nodes are dropped.
    """
    label = "label" if "label" in edges.columns else "dst"
    best = [F.min(F.struct("conf", F.col(label).alias("label"))).alias("b")] if with_path else [F.min("conf").alias("conf")]  # labels are for paths only
    given = lambda c, other: F.col(c) if c in roots.columns else other.alias(c)
    start = roots.select("root", "node", given("depth", F.lit(0)), given("conf", F.lit(0)), given("path", F.array("node"))).distinct()
    names = ["root", "node", "depth", "conf", *(["path"] if with_path else [])]
    start = start.groupBy("root", "node").agg(F.min(F.struct(*names[2:])).alias("b")).select("root", "node", "b.*", F.lit(MET).alias("kind"))
    frontier = materialize(start, "reach")
    parts = parts_of(edges)
    steps = _dealt(edges, parts).groupBy("src", "dst").agg(*best).select("src", "dst", "b.*" if with_path else "conf", F.lit(MET).alias("kind"))
    steps = _stored(steps, parts)
    levels, walked, begun = [frontier], 0, start.select("node")
    while True:
        walked += 1
        if walked == SHALLOW:
            steps = _kinds(steps, begun, parts)
        rank = [(F.col("f.depth") + 1).alias("depth"), F.greatest("f.conf", "e.conf").alias("conf")]
        if with_path:
            rank.append(F.array_append("f.path", F.col("e.label")).alias("path"))
        on = F.col("f.node") == F.col("e.src")
        step = frontier.filter(F.col("kind") != LAST).alias("f").join(steps.alias("e"), on if max_depth is None else on & (F.col("f.depth") < max_depth))
        step = step.select(F.col("f.root").alias("root"), F.col("e.dst").alias("node"), F.struct(*rank, "e.kind").alias("best"))
        step = step.groupBy("root", "node").agg(F.min("best").alias("best")).select("root", "node", "best.*")
        step = step.join(_all(levels).filter(F.col("kind") == MET).select("root", "node"), ["root", "node"], "left_anti")
        frontier = materialize(step, "reach", ["kind"])
        if frontier.isEmpty():
            drop(frontier)
            break
        levels.append(frontier)
        if len(levels) > COMPACT:
            levels = [_one(levels[:-1], "reach", ["kind"]), frontier]
    drop(steps)
    found = _all(levels).select(*names, "kind")
    if walked < SHALLOW:
        return found.drop("kind")  # each (root, node) once, as it is stored
    ends = found.filter(F.col("kind") == LAST).groupBy("root", "node").agg(F.min(F.struct(*names[2:])).alias("b")).select("root", "node", "b.*")
    ends = ends.join(found.filter(F.col("kind") == MET).select("root", "node"), ["root", "node"], "left_anti")  # met on the first levels
    out = materialize(found.filter(F.col("kind") != LAST).select(*names).unionByName(ends), "reached")
    for t in levels:
        drop(t)
    return out


ONCE, MET, LAST = 0, 1, 2  # kinds of nodes: met once at most by each root; met again; met again, but nothing follows


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    """Edges dealt out by src, once for putting them together and for their buckets, if there is more than one part of them."""
    return edges.repartition(parts, "src") if parts > 1 else edges


def _stored(steps: DataFrame, parts: int) -> DataFrame:
    """Edges dealt out by ``_dealt`` in a bucket for each part."""
    return bucketed(steps, "steps", parts, "src") if parts > 1 else materialize(steps, "steps")


def _kinds(edges: DataFrame, start: DataFrame, parts: int) -> DataFrame:
    """``edges`` with the kind of their dst, which tells what a walk must remember of it.

    A node with one predecessor that no walk begins at is met once. One that nothing follows can be met at each level without harm,
    and the best row is chosen at the end. Only the others have to be looked up at every level.
    """
    one = lambda rows, c, *n: rows.select(F.col(c).alias("dst"), *[F.lit(x).alias(k) for x, k in zip(n, ("n", "out", "begun"), strict=True)])
    each = one(edges, "dst", 1, 0, 0).unionByName(one(edges, "src", 0, 1, 0)).unionByName(one(start, "node", 0, 0, 1))
    sums = each.groupBy("dst").agg(*[F.sum(c).alias(c) for c in ("n", "out", "begun")])
    kind = F.when(F.col("begun") > 0, MET).when(F.col("n") < 2, ONCE).when(F.col("out") > 0, MET).otherwise(LAST)
    kinds = sums.filter("n > 0").select("dst", kind.alias("kind"))
    steps = _stored(_dealt(edges.drop("kind").join(kinds, "dst"), parts), parts)
    drop(edges)
    return steps


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _one(tables: list[DataFrame], what: str, by: list[str] | None = None) -> DataFrame:
    """One table of several, which are deleted."""
    out = materialize(_all(tables), what, by)
    for t in tables:
        drop(t)
    return out


def unfold(edges: DataFrame, root: str, max_depth: int) -> DataFrame:
    """(path, node, depth, repeated) of the call tree under ``root``: a node met again on its own path is shown, not entered.

    Level by level; the number of rows is that of the paths, so this is for trees and bounded graphs.
    """
    steps = materialize(edges.select("src", "dst").distinct(), "steps")
    first = edges.sparkSession.createDataFrame([([root], root, 0, False)], "path array<string>, node string, depth int, repeated boolean")
    levels = [materialize(first, "tree")]
    for _ in range(max_depth):
        at = levels[-1].filter("not repeated").join(steps, F.col("node") == F.col("src"))
        nxt = at.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("dst")).alias("repeated"))
        nxt = materialize(nxt, "tree")
        if nxt.isEmpty():
            drop(nxt)
            break
        levels.append(nxt)
    drop(steps)
    return _one(levels, "unfolded").withColumn("path", F.array_join("path", " -> "))


def _place(n: Column) -> Column:
    """A place from 1 on as bytes that stand in its order: one for those below 255, else five."""
    return F.unhex(F.when(n < 255, F.lpad(F.hex(n), 2, "0")).otherwise(F.concat(F.lit("FF"), F.lpad(F.hex(n), 8, "0"))))


def depth_first(edges: DataFrame, roots: DataFrame, max_depth: int, with_path: bool = True) -> DataFrame:
    """(root, node, depth, conf[, path]) as a depth-first walk meets the nodes, which enters each node once and none beyond ``max_depth``.

    ``edges`` has src, dst, conf, label and ``at``, which orders a node's edges; ``roots`` is as for ``reach``. A node first met
    deep isn't entered again from nearer, so under a depth limit the walk may miss what ``reach`` finds.

    The walk meets edges in the order of their keys: the places of the edges that lead to a node, one for each step. A node's key is the least that
    one of its predecessors gives, of those that are entered themselves. Each round works all keys out from the last round's, for all roots at
    once, until none changes; a node's key is right once those before it are, and a wrong one dies when it outgrows the depth limit. Keys are
    bytes, as they go through a shuffle in each round; paths go with them only if they are asked for.
    """
    named = ["path"] if with_path else []
    ranked = edges.repartition("src").groupBy("src", "dst").agg(F.min(F.struct("at", "conf", "label")).alias("b")).select("src", "dst", "b.*")
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("src").orderBy("at", "dst")))
    steps = materialize(ranked.select("src", "dst", "conf", *(["label"] if with_path else []), _place(F.col("place")).alias("place")), "steps")
    given = lambda c, other: F.col(c) if c in roots.columns else other.alias(c)
    start = roots.select("root", "node", given("depth", F.lit(0)), given("conf", F.lit(0)), given("path", F.array("node"))).distinct()
    order = F.row_number().over(W.partitionBy("root").orderBy("depth", "conf", "path", "node"))
    start = start.groupBy("root", "node").agg(F.min(F.struct("depth", "conf", "path")).alias("b")).select("root", "node", "b.*")
    first = materialize(start.select("root", "node", _place(order).alias("key"), "depth", "conf", *named), "walk")
    met, last = first, None
    while True:
        now = tuple(met.agg(F.count("*"), F.bit_xor(F.xxhash64("root", "node", "key"))).first())
        if now == last:
            break
        last = now
        on = (F.col("f.node") == F.col("e.src")) & (F.col("f.depth") < max_depth)
        step = met.alias("f").join(steps.alias("e"), on)
        path = [F.array_append("f.path", F.col("e.label")).alias("path")] if with_path else []
        best = F.struct(F.concat("f.key", "e.place").alias("key"), (F.col("f.depth") + 1).alias("depth"), F.greatest("f.conf", "e.conf").alias("conf"), *path)
        step = step.select(F.col("f.root").alias("root"), F.col("e.dst").alias("node"), best.alias("best"))
        step = step.unionByName(first.select("root", "node", F.struct("key", "depth", "conf", *named).alias("best")))
        nxt = materialize(step.groupBy("root", "node").agg(F.min("best").alias("best")).select("root", "node", "best.*"), "walk")
        if met is not first:
            drop(met)
        met = nxt
    drop(steps)
    return met.drop("key")


FEW = 1_000  # pairs whose closure, a million at most, is simply stored
BLOCK = 2_048  # nodes of a chain that are one row
TASK_PAIRS = 4_000_000  # pairs that a task makes out of blocks


def closure(pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(sub, ancestor, depth) of the transitive closure of (sub, super), by least depth; nothing is its own ancestor, circles included.

    Beyond ``FEW`` pairs, nodes between which there is no choice (the one has no other super, the other no other sub) are put into chains. Only a
    chain's last node leads out of it and only its first is led to, so the closure of the graph of chains is worked out and stored, and the
    pairs of nodes, each once, are made by whoever reads the result: they take no disk, however many there are.
    """
    first = pairs.filter("sub <> super").select("sub", F.col("super").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    first = materialize(first, "closure")
    out = _all(_doubled(first, max_depth)) if first.count() <= FEW else _by_chains(first, max_depth)
    return out if max_depth is None else out.filter(F.col("depth") <= max_depth)


def _doubled(first: DataFrame, max_depth: int | None) -> list[DataFrame]:
    """The closure of edges of depth 1, as a table for each round, of depths from half of ``reached`` to that.

    Each round doubles the reach: a chain of a thousand takes ten. It puts what is exactly ``reached`` steps away before all that is known, since
    a shortest chain of more steps has such a node on its way. So along a chain each pair is made once, and only pairs not met before are stored.
    """
    found, reached = [first], 1
    while max_depth is None or reached < max_depth:
        far = found[-1].filter(F.col("depth") == reached).select("sub", F.col("ancestor").alias("_mid"))
        up = _all(found).select(F.col("sub").alias("_mid"), "ancestor", (F.col("depth") + reached).alias("depth"))
        longer = far.join(up, "_mid").filter("sub <> ancestor").groupBy("sub", "ancestor").agg(F.min("depth").alias("depth"))
        nxt = materialize(longer.join(_all(found).select("sub", "ancestor"), ["sub", "ancestor"], "left_anti"), "closure")
        if nxt.isEmpty():
            drop(nxt)
            break
        found.append(nxt)
        reached *= 2
    return found


def _by_chains(edges: DataFrame, max_depth: int | None) -> DataFrame:
    """The closure of ``edges`` (sub, ancestor), which are deleted, as a plan over chains in blocks."""
    parts = parts_of(edges)
    placed, used = _chains(edges, parts)
    blocks = dealt(placed, parts, "chain").groupBy("chain", F.expr(f"at div {BLOCK}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))
    blocks = materialize(blocks.select("chain", "block", F.transform("nodes", lambda x: x["node"]).alias("nodes")), "blocks")
    sized = materialize(blocks.groupBy("chain").agg(F.sum(F.size("nodes")).alias("n")), "chains")
    chain = F.struct(F.col("chain").alias("node"), "n")
    to = edges.select("sub", "ancestor").join(sized.select(F.col("chain").alias("ancestor"), chain.alias("_to")), "ancestor")  # chains are named by their first nodes
    out_of = to.join(placed.select(F.col("node").alias("sub"), "chain", "at"), "sub").join(sized, "chain")
    steps = materialize(out_of.select(chain.alias("sub"), F.col("_to").alias("ancestor"), (F.col("at") + 1).alias("depth"), F.lit(1).alias("steps")), "links")
    for t in [edges, *used]:
        drop(t)
    links = _weighted(steps, max_depth)
    single = (F.col("sub.n") == 1) & (F.col("ancestor.n") == 1)
    plain = links.filter(single & (F.col("sub") != F.col("ancestor"))).select(F.col("sub.node").alias("sub"), F.col("ancestor.node").alias("ancestor"), F.col("depth").cast("int").alias("depth"))
    within = sized.filter("n > 1").select(chain.alias("sub"), chain.alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    long = links.filter(~single).select("sub", "ancestor", "depth").unionByName(within)
    pairs = long.agg(F.sum(F.col("sub.n").cast("double") * F.col("ancestor.n") / F.when(F.col("depth") == 0, 2).otherwise(1))).first()[0]
    if not pairs:
        return plain
    each = lambda c: F.explode(F.expr(f"sequence(0, cast(({c}.n - 1) div {BLOCK} as int))"))
    own = F.col("sub") == F.col("ancestor")
    most = F.when(own & (F.col("depth") > 0), F.col("depth") - 1).otherwise(F.lit(2**62))  # round a circle: only to what comes before in the chain
    units = long.withColumn("_from", each("sub")).withColumn("_to", each("ancestor"))
    units = units.filter(~own | F.when(F.col("depth") == 0, F.col("_to") >= F.col("_from")).otherwise(F.col("_to") <= F.col("_from")))
    units = units.select(F.col("sub.node").alias("_p"), "_from", F.col("ancestor.node").alias("_q"), "_to", (F.col("depth") + (F.col("_to") - F.col("_from")).cast("long") * BLOCK).alias("_base"), most.alias("_most"))
    units = units.join(blocks.select(F.col("chain").alias("_p"), F.col("block").alias("_from"), F.col("nodes").alias("_subs")), ["_p", "_from"])
    units = units.join(blocks.select(F.col("chain").alias("_q"), F.col("block").alias("_to"), F.col("nodes").alias("_ancestors")), ["_q", "_to"])
    units = units.repartition(max(1, -(-int(pairs) // TASK_PAIRS)), "_p", "_from", "_q", "_to")
    made = units.select("_base", "_most", "_ancestors", F.posexplode("_subs").alias("_i", "sub"))
    made = made.select((F.col("_base") - F.col("_i")).alias("_base"), "_most", "sub", F.posexplode("_ancestors").alias("_j", "ancestor"))
    made = made.withColumn("depth", F.col("_base") + F.col("_j")).filter("depth > 0 and depth <= _most").select("sub", "ancestor", F.col("depth").cast("int").alias("depth"))
    return made.unionByName(plain)


def _weighted(first: DataFrame, max_steps: int | None) -> DataFrame:
    """(sub, ancestor, depth, steps) of the closure of edges with any depths, by least depth, then fewest steps; whatever is on a circle is its own ancestor, too.

    Rounds double the steps, as in ``_doubled``; but more steps may be nearer, so a pair may be stored again with a lesser depth.
    """
    least = lambda rows: rows.groupBy("sub", "ancestor").agg(F.min(F.struct("depth", "steps")).alias("b"))
    found, reached = [first], 1
    while not found[-1].isEmpty() and (max_steps is None or reached < max_steps):
        far = found[-1].filter(F.col("steps") == reached).select("sub", F.col("ancestor").alias("_mid"), F.col("depth").alias("_depth"))
        up = _all(found).select(F.col("sub").alias("_mid"), "ancestor", "depth", "steps")
        longer = least(far.join(up, "_mid").select("sub", "ancestor", (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("steps") + reached).alias("steps")))
        known = least(_all(found)).withColumnRenamed("b", "k")
        found.append(materialize(longer.join(known, ["sub", "ancestor"], "left").filter("k is null or b < k").select("sub", "ancestor", "b.*"), "links"))
        reached *= 2
    if len(found) == 1:
        return first
    out = materialize(least(_all(found)).select("sub", "ancestor", "b.*"), "links")
    for t in found:
        drop(t)
    return out


def _chains(edges: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, chain, at) of every node of ``edges``: the first node of its chain and the steps from there; and the tables that this reads.

    A chain goes on over an edge if its sub has no other super and its ancestor no other sub. A circle that nothing else touches begins at its least node.
    """
    one = lambda by, other: dealt(edges, parts, by).groupBy(by).agg(F.min(other).alias(other), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    plain = one("sub", "ancestor").join(one("ancestor", "sub"), ["sub", "ancestor"]).select(F.col("ancestor").alias("node"), F.col("sub").alias("to"))
    nodes = edges.select(F.col("sub").alias("node")).unionByName(edges.select(F.col("ancestor").alias("node"))).distinct()
    links = materialize(nodes.join(plain, "node", "left"), "placed")
    placed, left, used = _placed(links, parts)
    used.append(links)
    if left is not None:
        cut = links.join(left, "node").select("node", F.when(F.col("node") != F.col("low"), F.col("to")).alias("to"))
        more, _, tables = _placed(cut, parts)
        placed, used = placed.unionByName(more), used + tables
    return placed, used


def _placed(links: DataFrame, parts: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(node, chain, at) by ``to``, the node before (null: none); (node, low) of those on circles with their circle's least node, if any; the tables read.

    Each round goes back twice as far as the one before. Once a round places no node, what is left is on circles.
    """
    names = ["node", "done", "to", "at", "low"]
    start = links.select("node", F.col("to").isNull().alias("done"), F.coalesce("to", "node").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("at"), F.col("node").alias("low"))
    tables = [materialize(start.withColumn("moved", F.lit(True)), "placed")]
    left = tables[0].filter("not done")
    n, last, moves = left.count(), None, True
    while n and (n != last or moves):
        known = _all([t.filter("done") for t in tables] + [left]).select(*[F.col(c).alias(f"_{c}") for c in names])
        nxt = dealt(left, parts, "to").join(dealt(known, parts, "_node"), F.col("to") == F.col("_node"))
        low = F.least("low", "_low")
        nxt = nxt.select("node", F.col("_done").alias("done"), F.col("_to").alias("to"), (F.col("at") + F.col("_at")).alias("at"), low.alias("low"), (low != F.col("low")).alias("moved"))
        tables.append(materialize(nxt, "placed"))
        left = tables[-1].filter("not done")
        told = left.agg(F.count("*"), F.bool_or("moved")).first()
        n, last, moves = told[0], n, told[1]
    placed = _all([t.filter("done").select("node", F.col("to").alias("chain"), "at") for t in tables])
    return placed, left.select("node", "low") if n else None, tables

"""Depth-first walks, closures, and many strings in many texts against plain versions."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from ripplegraph import storage
from ripplegraph.operators import mentions as mentioned
from ripplegraph.operators.mentions import mentions
from ripplegraph.plans import reach as plans
from ripplegraph.storage import read_lines, write_text


def walked(edges, root, limit):
    """Nodes with depth, certainty and path as a recursive walk meets them."""
    after, met = {}, {}
    for src, dst, conf, label, at in sorted(edges, key=lambda e: (e[0], e[4], e[1])):
        after.setdefault(src, []).append((dst, conf, label))

    def enter(node, depth, conf, path):
        if node in met:
            return
        met[node] = (depth, conf, path)
        if depth < limit:
            for dst, c, label in after.get(node, []):
                enter(dst, depth + 1, max(conf, c), [*path, label])

    enter(root, 0, 0, [root])
    return met


@pytest.mark.parametrize("seed,nodes,count,limit", [(1, 12, 30, 30), (2, 12, 30, 3), (3, 25, 60, 5), (4, 8, 40, 4), (5, 40, 60, 12)])
def test_depth_first_walk(spark, seed, nodes, count, limit):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(count)}
    edges = [(a, b, rng.randrange(3), b.upper(), at) for at, (a, b) in enumerate(rng.sample(sorted(pairs), len(pairs)))]
    roots = ["n0", "n1", "n2"]
    got = plans.depth_first(spark.createDataFrame(edges, "src string, dst string, conf int, label string, at int"), spark.createDataFrame([(r, r) for r in roots], "root string, node string"), limit)
    found = {(r["root"], r["node"]): (r["depth"], r["conf"], r["path"]) for r in got.collect()}
    assert found == {(r, n): v for r in roots for n, v in walked(edges, r, limit).items()}


def test_depth_first_keys_are_bytes_in_order(spark, monkeypatch):
    """Keys and paths used to go through each round as arrays; places beyond one byte keep their order."""
    kept, some = [], plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, what: kept.append(df.columns + [t for c, t in df.dtypes if c == "key"]) or some(df, what))
    edges = [("a", f"b{i}", 0, "x", i) for i in range(600)] + [(f"b{i}", f"c{i // 300}", 0, "x", 0) for i in range(599, 200, -1)] + [("c0", "d", 0, "x", 0), ("b599", "e", 0, "x", 1), ("b254", "e", 0, "x", 1)]
    frame, root = spark.createDataFrame(edges, "src string, dst string, conf int, label string, at int"), spark.createDataFrame([("a", "a")], "root string, node string")
    got = {r["node"]: (r["depth"], r["conf"]) for r in plans.depth_first(frame, root, 9, with_path=False).collect()}
    assert got == {n: v[:2] for n, v in walked(edges, "a", 9).items()}
    assert all("path" not in c and "label" not in c for c in kept) and all(c[-1] == "binary" for c in kept if "key" in c)
    paths = {r["node"]: r["path"] for r in plans.depth_first(frame.withColumn("label", F.concat("src", "dst")), root, 9).collect()}
    assert paths["c0"] == ["a", "ab201", "b201c0"] and paths["c1"] == ["a", "ab300", "b300c1"] and paths["e"] == ["a", "ab254", "b254e"]


def test_both_orders_differ_under_a_limit(spark):
    """a calls b and then c; b leads to c the long way, so a depth-first walk meets c at the limit and doesn't enter it."""
    edges = [("a", "b", 0, "b", 0), ("a", "c", 0, "c", 1), ("b", "x", 0, "x", 0), ("x", "c", 0, "c", 0), ("c", "d", 0, "d", 0)]
    frame, root = spark.createDataFrame(edges, "src string, dst string, conf int, label string, at int"), spark.createDataFrame([("a", "a")], "root string, node string")
    deep = {r["node"]: r["depth"] for r in plans.depth_first(frame, root, 3).collect()}
    wide = {r["node"]: r["depth"] for r in plans.reach(frame, root, 3).collect()}
    assert deep == {"a": 0, "b": 1, "x": 2, "c": 3} and wide == {"a": 0, "b": 1, "c": 1, "x": 2, "d": 2}


def test_closure_doubles_its_reach(spark, monkeypatch):
    rounds = []
    some = plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, what: rounds.append(what) or some(df, what))
    chain = spark.range(300).select(F.col("id").alias("sub"), (F.col("id") + 1).alias("super"))
    got = plans.closure(chain)
    assert got.count() == 300 * 301 // 2 and got.filter("ancestor - sub <> depth").isEmpty() and len(rounds) <= 11
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "sub string, super string")
    assert {tuple(r) for r in plans.closure(ring).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "a", 2), ("b", "d", 2), ("c", "a", 1), ("c", "d", 1), ("c", "b", 2)}
    assert {tuple(r) for r in plans.closure(ring, 1).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)}


def test_closure_stores_each_pair_once(spark, monkeypatch):
    """Rounds used to put all pairs together with all pairs and to store all of them again."""
    stored, some = [], plans.materialize

    def counted(df, what):
        table = some(df, what)
        stored.append(table.count())
        return table

    monkeypatch.setattr(plans, "materialize", counted)
    chain = spark.range(100).select(F.col("id").alias("sub"), (F.col("id") + 1).alias("super"))
    plans.closure(chain)
    assert sum(stored) == 100 * 101 // 2


def test_closure_of_any_graph(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    want = {}
    for root in range(30):
        front, depth, met = {root}, 0, set()
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - met - {root}
            met |= front
            want |= {(root, n): depth for n in front}
    for limit in (None, 3, 4):
        got = plans.closure(spark.createDataFrame(edges, "sub int, super int"), limit)
        assert sorted(tuple(r) for r in got.collect()) == sorted((*k, v) for k, v in want.items() if limit is None or v <= limit)


def test_closure_by_chains_stores_no_pairs(spark, monkeypatch):
    """A chain of n used to store its n * (n + 1) / 2 pairs, which for long chains filled any disk."""
    stored, some = [], plans.materialize

    def counted(df, what):
        table = some(df, what)
        stored.append(table.count())
        return table

    monkeypatch.setattr(plans, "materialize", counted)
    chain = spark.range(5000).select(F.col("id").alias("sub"), (F.col("id") + 1).alias("super"))
    got = plans.closure(chain)
    assert sum(stored) < 20 * 5000
    assert got.count() == 5000 * 5001 // 2 and got.filter("ancestor - sub <> depth").isEmpty()
    assert plans.closure(chain, 7).count() == sum(5001 - d for d in range(1, 8))


@pytest.mark.parametrize("seed", range(4))
def test_closure_by_chains_of_any_graph(spark, monkeypatch, seed):
    """Chains of all lengths, blocks of few nodes, circles alone, circles that are met and left, ways of several lengths."""
    monkeypatch.setattr(plans, "FEW", 0)
    monkeypatch.setattr(plans, "BLOCK", 3)
    monkeypatch.setattr(plans, "TASK_PAIRS", 50)
    rng = random.Random(seed)
    hubs = [f"h{i}" for i in range(7)]
    edges = {(f"o{i}", f"o{(i + 1) % 8}") for i in range(8)} | {("p0", "p1"), ("p1", "p0"), ("s", "s")}
    for k in range(8 + 2 * seed):
        way = [rng.choice(hubs), *[f"w{k}.{i}" for i in range(rng.randrange(8))], rng.choice(hubs)]
        edges |= set(zip(way, way[1:]))
    after, want = {}, set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for root in {x for e in edges for x in e}:
        front, depth, met = {root}, 0, {root}
        while front:
            depth += 1
            front = {b for a in front for b in after.get(a, ())} - met
            met |= front
            want |= {(root, n, depth) for n in front}
    frame = spark.createDataFrame([*sorted(edges), *sorted(edges)[:5], ("h0", None), (None, "h0")], "sub string, super string")
    for limit in (None, 5):
        assert sorted(tuple(r) for r in plans.closure(frame, limit).collect()) == sorted(x for x in want if limit is None or x[2] <= limit)
    assert plans.closure(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3, 100_000])
def test_mentions(spark, monkeypatch, most):
    monkeypatch.setattr(mentioned, "MOST", most)
    texts = [("a", "send(orders.paid:x)"), ("b", "ordersordersünder"), ("c", None), ("d", ""), ("e", "日本 topic")]
    words = [("orders.paid:x", "orders.paid:x"), ("orders.paid:x", "orders.paid"), ("orders", "orders"), ("ü", "ü"), ("日", "日"), ("none", "none"), ("same", "orders"), (":t", "")]
    got = sorted(tuple(r) for r in mentions(spark.createDataFrame(texts, "key string, text string"), words).collect())
    assert got == sorted({(v, k) for k, t in texts if t is not None for v, w in words if w in t})
    assert mentions(spark.createDataFrame(texts, "key string, text string"), []).count() == 0


def test_one_pass_looks_for_any_number_of_strings(spark, monkeypatch):
    """Each 100,000 strings used to take a pass over the texts."""
    passes, some = [], mentioned._pass
    monkeypatch.setattr(mentioned, "_pass", lambda *a: passes.append(1) or some(*a))
    monkeypatch.setattr(mentioned, "STEP", 7)
    texts = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("日 x"), F.repeat(F.lit("ab"), F.col("id").cast("int")), F.lit("w"), (F.col("id") * 9973).cast("string"), F.lit("ü")).alias("text"))
    words = spark.range(130_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("value"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("string")).unionByName(spark.createDataFrame([("long", "abababababababababw1"), ("long", "x"), ("none", "bb")], "value string, string string"))
    want = {(f"w{str(i * 9973)[:k]}", i) for i in range(40) for k in range(1, 8) if int(str(i * 9973)[:k]) < 130_000} | {("long", i) for i in range(40)}
    got = [tuple(r) for r in mentions(texts, words).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(passes) == 1


def test_lines_become_one_file(spark, tmp_path):
    lines = spark.range(20_000).select("id", F.concat(F.lit('"line\nü '), F.col("id").cast("string"), F.lit('"')).alias("line")).repartition(9)
    write_text(lines.orderBy("id"), f"{tmp_path}/out.csv", "head\n")
    assert (tmp_path / "out.csv").read_text() == "head\n" + "".join(f'"line\nü {i}"\n' for i in range(20_000))
    write_text(lines.limit(0), f"{tmp_path}/none.csv", "head\n")
    assert (tmp_path / "none.csv").read_text() == "head\n"


def test_lines_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    """A file used to be one record of one task."""
    lines = [f"{i} ü\r" * (i % 5) for i in range(5_000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode() + b"\nlast\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_lines(spark, f"{tmp_path}/a.txt")
        rows = got.orderBy("line_no").collect()
        assert got.rdd.getNumPartitions() > 3 and [tuple(r) for r in rows] == list(enumerate([*lines, "last"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


sys.setrecursionlimit(10_000)


@pytest.mark.parametrize("shallow,compact", [(1, 2), (2, 12), (6, 3)])
def test_deep_walks_remember_what_can_come_again(spark, monkeypatch, shallow, compact):
    monkeypatch.setattr(plans, "SHALLOW", shallow)
    monkeypatch.setattr(plans, "COMPACT", compact)
    rng = random.Random(shallow)
    edges = {(i, i + 1) for i in range(12)} | {(rng.randrange(13), rng.randrange(13)) for _ in range(6)} | {(rng.randrange(13), 20 + rng.randrange(4)) for _ in range(12)} | {(5, 0), (40, 41), (41, 40)}
    conf = {e: rng.randrange(3) for e in edges}
    roots = [0, 3, 22, 40]
    want = {}
    for r in roots:
        met, front = {r: (0, 0)}, {r: 0}
        for depth in range(1, 30):
            nxt = {}
            for (a, b), c in conf.items():
                if a in front and b not in met:
                    nxt[b] = min(nxt.get(b, 9), max(front[a], c))
            met |= {n: (depth, c) for n, c in nxt.items()}
            front = nxt
        want |= {(r, n): v for n, v in met.items()}
    frame = spark.createDataFrame([(a, b, c) for (a, b), c in conf.items()], "src int, dst int, conf int")
    got = plans.reach(frame, spark.createDataFrame([(r, r) for r in roots], "root int, node int"), None)
    assert sorted(tuple(r) for r in got.collect()) == sorted((*k, *v) for k, v in want.items())


@pytest.mark.parametrize("shallow,with_path", [(2, False), (6, False), (6, True)])
def test_levels_do_not_shuffle_all_edges(spark, monkeypatch, shallow, with_path):
    """Each level used to shuffle all edges again, with labels that no path asked for, and a shallow walk stored its rows twice."""
    plain, stored, some, into = [], {}, plans.materialize, storage.bucketed

    def seen(df, what, *a):
        (plain if what == "reach" else stored.setdefault(what, [])).append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return some(df, what, *a)

    monkeypatch.setattr(plans, "materialize", seen)
    monkeypatch.setattr(plans, "bucketed", lambda df, what, *a: stored.setdefault(what, []).append((df.columns, "")) or into(df, what, *a))
    monkeypatch.setattr(plans, "SHALLOW", shallow)
    monkeypatch.setattr(storage, "PART_ROWS", 40)
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(3)) for _ in range(150)]
    edges += [(a, b, (c + 1) % 3) for a, b, c in edges[:60]]  # some twice, with another certainty
    best, roots, want = {}, ["n0", "n1", "n2"], {}
    for a, b, c in edges:
        best[a, b] = min(c, best.get((a, b), 9))
    for r in roots:
        met, front = {r: (0, 0, [r])}, {r: (0, [r])}
        for depth in range(1, 4):
            nxt = {}
            for (a, b), c in best.items():
                if a in front and b not in met:
                    found = max(front[a][0], c), [*front[a][1], b]
                    nxt[b] = min(nxt.get(b, found), found)
            met |= {n: (depth, *v) for n, v in nxt.items()}
            front = nxt
        want |= {(r, n): v if with_path else v[:2] for n, v in met.items()}
    frame = spark.createDataFrame(edges, "src string, dst string, conf int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plans.reach(frame, spark.createDataFrame([(r, r) for r in roots], "root string, node string"), 3, with_path).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {(r["root"], r["node"]): tuple(r)[2:] for r in got} == want and len(got) == len(want) > 30
    assert len(plain) > 3 and not any("hashpartitioning(src" in p for _, p in plain)
    assert ("reached" in stored) == (shallow == 2) and all(("label" in c) == with_path for c, _ in stored["steps"])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("steps")]

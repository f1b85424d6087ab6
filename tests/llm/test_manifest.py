"""Merkle manifest and resampling against plain versions on rows with nulls, repeats and clashing names."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import merkle, oracle_sql, queries, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["place", "node", "n", "root", "block", "lefts", "leaf", "score", "rank", "weight"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(leaves):
    """(root, siblings by level of each leaf) by the definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            first = i // 16 * 16
            way.append((level[first:i], level[i + 1 : first + 16]))
            i //= 16
        ways.append(way)
    return levels[-1][0], ways


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(int(i), f"Text Number {i} Ü", "en" if i % 3 else None, "big", int(i)) for i in rng.permutation(900)]
    out += [(i, None if i % 4 == 0 else "Same", "", f"s{i % 7}", None) for i in range(1000, 1060)] + [(5000, "Lone", "en", None, 3), (5001, "", "en", "", 0), (None, "No Id", "de", "big", 1)]
    return out + [out[3], out[3], (out[4][0], "Another Text", "en", "big", 9)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("manifest"))
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHES})
    frame.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "text number 7"), (2, None), (3, "Same same same")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def by_sql(folder, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return db.execute(oracle_sql()[name])


def test_manifest(spark, rows, folder):
    by = defaultdict(list)
    for r in rows:
        crc = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        changed = (r[0], lower(r[1]), *r[2:]) if crc % 5 == 0 and r[1] is not None else r
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(changed), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:4])]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    want = Counter()
    for place, s in enumerate(names):
        for x, way in zip(sorted(by[s], key=lambda x: x[:4]), trees[s][1], strict=True):
            whole = [*way, *over[place]]
            node = x[3]
            for left, right in whole:
                node = h("".join([*left, node, *right]))
            want[x[4], x[2], trees[s][0], root, h("".join(d for left, right in whole for d in [*left, *right])), node, node == root] += 1
    frame = queries()["op12_merkle_manifest"](spark, folder)
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(tuple(r) for r in frame.collect())
    assert got == want and {True, False} == {k[-1] for k in got}
    assert Counter(by_sql(folder, "op12_merkle_manifest").fetchall()) == Counter((*k,) for k in got.elements())


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4096, 4097, 4400])
def test_blocks_give_the_tree_of_the_definition(n):
    leaves = [h(str(i)) for i in range(n)]
    root, ways = tree(leaves)
    tops, sides = merkle.matrix(leaves), []
    while True:  # what climbed() and lowered() do, block by block
        blocks = [merkle.levels(tops[i : i + merkle.BLOCK], len(tops) <= merkle.BLOCK) for i in range(0, len(tops), merkle.BLOCK)]
        sides.append(blocks)
        tops = merkle.matrix([b[-1].tobytes().decode() for b in blocks])
        if len(tops) == 1:
            break
    assert tops.tobytes().decode() == root
    for i in {0, n // 2, n - 1}:
        at, lefts, rights = i, [], []
        for blocks in sides:
            left, right = merkle.siblings(blocks[at // merkle.BLOCK], at % merkle.BLOCK)
            lefts, rights, at = lefts + left, rights + right, at // merkle.BLOCK
        assert [("".join(a), "".join(b)) for a, b in ways[i]] == list(zip(lefts, rights, strict=True))
        assert merkle.folded(leaves[i], lefts, rights) == root


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none, "source", "doc_id", merkle.FIELDS, {}).count() == 0
    assert resampling.resample(none, none, "text", "doc_id", 5, 20, 42).count() == 0


def features(text):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower(text or "")).split(" ") if w]
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_resampling(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocabulary = ["the", "River", "don't", "Übersicht", "a b", "x-1", "日本", "42", "gar"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))), "s") for i in range(300)] + [(400, None, "s"), (401, "", "s"), (402, "!?", "s"), (403, "word " * 30_000, "s"), (None, "the river " * 20, "s")]
    rows += [rows[5], rows[5]]
    target = [(1, "the river the river"), (2, None), (3, "gar 42")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({c: F.lit("x") for c in ("weight", "rank", "place")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    have, want = (Counter(bucket(f) for r in table for f in features(r[1])[1]) for table in (rows, target))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000))))
    made = []
    for i, text, _ in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        u = (int(h(f"42:{'' if i is None else i}")[:8], 16) + 0.5) / 4294967296
        made.append((len(words) >= 20, weight + math.floor(-1000 * math.log(-math.log(u))), i, len(found), weight))
    drawn = 5 * sum(m[0] for m in made) // 100
    order = sorted([m for m in made if m[0]], key=lambda m: (-m[1], m[2] is None, m[2] or 0))[:drawn]
    got = [tuple(r) for r in queries()["op13_importance_resampling"](spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(g[:4] for g in got) == Counter((i, n, w, sc) for _, sc, i, n, w in made)
    assert sorted((g[4], g[0], g[3]) for g in got if g[4] is not None) == [(k + 1, m[2], m[1]) for k, m in enumerate(order)]
    sql = by_sql(tmp_path, "op13_importance_resampling").fetchall()
    assert Counter(sql) == Counter(got)

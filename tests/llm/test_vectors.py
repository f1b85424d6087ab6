"""Vector searches against brute force."""

import duckdb
import numpy as np
import pytest

from ripplegraph.llm import vectors


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int")


def test_multi_index_visits_cells_in_order():
    x = np.random.default_rng(1).normal(size=(400, 8))
    index = vectors.MultiIndex(vectors.unit(x), 6)
    cells = index.cells(vectors.unit(x))
    index.sizes = np.bincount(cells, minlength=len(index.sizes))
    a, b = (d[0] for d in index.distances(vectors.unit(x[:1])))
    order = index.traverse(a, b, 400)
    away = [a[c // index.k] + b[c % index.k] for c in order]
    assert away == sorted(away) and index.sizes[order].sum() == 400
    few = index.traverse(a, b, 50)
    assert few == order[: len(few)] and index.sizes[few].sum() >= 50 > index.sizes[few[:-1]].sum()


def test_searches(spark, monkeypatch):
    for name, value in (("LARGEST", 64), ("SMALLEST", 32), ("QUERIES", 3), ("TOGETHER", 2), ("SEEDS", 40)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(12, size=500)] + rng.normal(size=(500, 16)) * 0.3).astype(np.float32)
    x[100:280] = x[50]  # copies of a query, more than a block
    rows = [(i, x[i].tolist(), 0, 9) for i in range(500)]
    rows += [(600, None, 0, 9), (650, [0.0] * 16, 0, 9), (601, [float("nan")] * 16, 0, 9), (602, [None] + [1.0] * 15, 0, 9), (603, [float("inf")] * 16, 0, 9), (None, [1.0] * 16, 0, 9)]
    frame = vectors_frame(spark, rows).repartition(6)
    v = x.astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(500)
    got = {}
    for r in vectors.cosine_search(frame).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 500, 50))
    hits = 0
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((ids, -s))[:5]
        hits += len(set(best.tolist()) & {c for _, c, _ in found})
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(unit[q] @ unit[c] - t) < 1e-12 for _, c, t in found)
    assert hits / (5 * len(got)) >= 0.9
    assert [c for _, c, _ in sorted(got[50])] == [100, 101, 102, 103, 104]  # ties to the smaller id
    z = np.floor(256 * np.vstack([v, np.zeros(16)]))
    zid = np.append(ids, 650)
    want = set()
    for q in range(0, 651, 50):
        if q < 500 or q == 650:
            s = z @ z[list(zid).index(q)]
            o = [j for j in np.lexsort((zid, -s)) if zid[j] != q][:5]
            want |= {(q, k + 1, int(zid[j]), int(s[j])) for k, j in enumerate(o)}
    assert {tuple(r) for r in vectors.product_search(frame).collect()} == want


def test_statistics_bound_products():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 64)) * 50, rng.normal(size=(40, 64)) * 50
    last = None
    for s in vectors.levels(64):
        (a, b), (c, d) = vectors.statistics(x, s), vectors.statistics(y, s)
        bound = a @ c.T + b @ d.T
        assert (bound >= x @ y.T - 1e-6).all() and (last is None or bound.mean() <= last)
        last = bound.mean()


def test_searches_of_few_vectors(spark):
    one = vectors_frame(spark, [(0, [1.0, 2.0], 0, 0), (1, [2.0, 1.0], 0, 0)])
    assert [tuple(r)[:3] for r in vectors.cosine_search(one).collect()] == [(0, 1, 1)]
    assert [tuple(r) for r in vectors.product_search(one).collect()] == [(0, 1, 1, 4 * 65536)]
    for rows in ([], [(0, None, 0, 0)], [(0, [0.5], 0, 0)]):
        assert vectors.cosine_search(vectors_frame(spark, rows)).count() == 0
        assert vectors.product_search(vectors_frame(spark, rows)).count() == 0


def test_every_row_that_asks_has_its_own_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), 0, 0) for i in range(40)]
    for search in (vectors.cosine_search, vectors.product_search):
        once = sorted(map(tuple, search(vectors_frame(spark, rows)).collect()))
        twice = sorted(map(tuple, search(vectors_frame(spark, [*rows, rows[0]])).collect()))
        assert twice == sorted(once * 2)
        other = sorted(map(tuple, search(vectors_frame(spark, [*rows, (0, rows[3][1], 0, 0)])).collect()))
        assert len(other) == 10 and {r[2] for r in other}.isdisjoint({0})


def test_vectors_meet_those_of_their_width(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 + i % 2).tolist(), 0, 0) for i in range(60)]
    for search in (vectors.cosine_search, vectors.product_search):
        got = search(vectors_frame(spark, rows)).collect()
        assert {(r["query_id"], r["rank"]) for r in got} == {(q, k) for q in (0, 50) for k in range(1, 6)} and all(r["vec_id"] % 2 == 0 for r in got)
    assert {r["query_id"] for r in vectors.product_search(vectors_frame(spark, [*rows, (1050, [1.0, 2.0], 0, 0)])).collect()} == {0, 50}


def test_products_beyond_a_double_or_a_long(spark):
    rows = [(0, [3e8, 1.0, -2e8], 0, 0), (1, [3e8, 0.5, 1e8], 0, 0), (2, [-3e8, 0.5, 1e8], 0, 0), (3, [1e30, 0.0, 0.0], 0, 0), (4, [1e30, 1.0, 0.0], 0, 0), (5, [2e-3, 1e-3, 0.0], 0, 0), (6, [-1e30, 0.0, 0.0], 0, 0)]
    z = {i: [int(np.floor(256.0 * np.float32(x))) for x in v] for i, v, _, _ in rows}
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    score = {i: clip(sum(a * b for a, b in zip(z[0], z[i], strict=True))) for i in range(1, 7)}
    best = sorted(score, key=lambda i: (-score[i], i))[:5]
    assert [tuple(r) for r in sorted(vectors.product_search(vectors_frame(spark, rows)).collect())] == [(0, k + 1, i, score[i]) for k, i in enumerate(best)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_test_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] is not None]
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x, ids = x[np.isfinite(x).all(axis=1) & x.any(axis=1)], ids[np.isfinite(x).all(axis=1) & x.any(axis=1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = vectors.op2_multi_index(spark, folder)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = out.collect()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        least = np.sort(s)[-5]
        mine = [r["score"] for r in got if r["query_id"] == q]
        assert len(mine) == 5
        hits += sum(t >= least - 1e-9 for t in mine)
        total += 5
    assert hits / total >= 0.9


def test_products_by_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    out = vectors.op9_segment_statistics(spark, "/root/testdata/sf0.01")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(vectors.OP9_SQL).fetchall())

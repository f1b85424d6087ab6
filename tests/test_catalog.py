"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ripplegraph import catalog, catalog_cases, catalog_engine, catalog_reports, catalog_rules, catalog_walks  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"q_engine_batch", "q_batch_resume", "q_engine_resources", "q_engine_hops", "q_engine_entries", "q_warnings", "q_shown_methods"}  # tests of the engine cover them


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in catalog.SQL if n not in SLOW])
def test_same_rows(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_have_a_twin():
    assert set(catalog.QUERIES) == set(catalog.SQL) and all(f.__doc__ for f in catalog.QUERIES.values())


def test_partitions_do_not_matter(spark):
    edges = catalog.all_edges(spark, DATA)
    from pyspark.sql import functions as F

    from ripplegraph.plans.reach import reach

    roots = edges.filter("src like 'R:%'").select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    a = reach(edges, roots, with_path=True).collect()
    b = reach(edges.repartition(7), roots.repartition(3), with_path=True).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_graph(spark):
    from ripplegraph.plans.reach import reach

    edges = spark.createDataFrame([], "src string, dst string, conf int")
    roots = spark.createDataFrame([("r", "a")], "root string, node string")
    assert [tuple(r) for r in reach(edges, roots).collect()] == [("r", "a", 0, 0)]
    assert reach(edges, roots.limit(0)).count() == 0

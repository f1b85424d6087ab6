"""Every query on one small folder: its columns and types, its constants, and its rows against plain versions."""

import itertools
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph import llm
from ripplegraph.llm import bpe, mixing
from tests.llm.test_operators import brute_components, brute_print, check_packed

#: Names that the operators give to columns of their own.
CLASHES = ["score", "n", "sum", "lang_pred", "held_out", "fp", "taken", "size", "target", "node", "key", "keys", "hashes", "component", "root", "piece", "length", "shard", "slot", "predicted", "toxic", "quality", "law", "rank"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    en, de = "the river runs past an old garden wall under trees in spring rain".split(), "der fluss läuft hinter einer alten mauer unter bäumen im regen dahin".split()
    rows, labels = [], []
    for i in range(300):
        words = rng.choice(de if i % 4 == 0 else en, int(rng.integers(20, 60))).tolist()
        if i % 6 == 1:
            words[5:5] = ["idiotic", "moronic", "scummy", "idiotic"]
        rows.append((i, " ".join(words), "de" if i % 4 == 0 else "en", f"s{i % 3}" if i % 7 else None))
        labels.append((i, 1, int(i % 6 == 1)))
    rows += [(300, None, None, "s1"), (301, "12 34 !", "en", "s1"), (302, "", "en", None), (303, "word " * 40_000, "en", "s0"), (None, "no number at all here", "en", "s0"), (None, "another one without", None, "s0")]
    rows += [(400 + i, rows[2][1], "en", "s2") for i in range(8)] + [rows[2], rows[2], (2, "the same number but another text", "en", "s1")]
    labels += [(5, 0, None), (None, 0, 1), (7, 1, 0), (7, 1, 1)]
    path = str(tmp_path_factory.mktemp("contracts"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in CLASHES}).withColumn("n_chars", F.length("text"))
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    html = [(1, "u", "<article><h1>T</h1><p>" + "A sentence of some length stands here. " * 9 + "</p></article><footer>f</footer>"), (2, None, None), (2, None, None), (3, "v", "")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    pages.withColumns({c: F.lit("x") for c in ("text", "n_chars")}).write.parquet(f"{path}/pages.parquet")
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(500, None), (550, [0.0] * 8), (None, [1.0] * 8), (600, [float("nan")] * 8), (650, [1.0, 2.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    frame.withColumns({c: F.lit("x") for c in ("id", "v", "cell", "rank", "score", "q")}).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def out(spark, folder):
    made = {}

    def of(n):
        if n not in made:
            (name,) = [q for q in llm.queries() if q.startswith(f"op{n}_")]
            frame = llm.queries()[name](spark, folder)
            made[n] = dict(frame.dtypes), frame.toPandas()
        return made[n]

    return of


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def ids(frame, column="doc_id"):
    return Counter(None if v != v or v is None else int(v) for v in frame[column])


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_op1(out, docs):
    types, t = out(1)
    assert {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}.items() <= types.items()
    assert ids(t) == Counter(d[0] for d in docs) and set(t["law"]) == {"key"}
    want = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(t["doc_id"], t["size"], t["text_crc32"], strict=True)) == want
    for r in t.itertuples():
        key = xxhash.xxh64_intdigest(struct.pack("<q", int(r.doc_id)), 42) if r.doc_id == r.doc_id else 42
        assert (r.shard, r.grown_shard) == (plain_jump(key, 40), plain_jump(key, 41))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in t.groupby("shard"))


def test_op2_and_op9(out):
    for n, kind in ((2, "double"), (9, "bigint")):
        types, t = out(n)
        assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": kind}
        assert {q: sorted(g["rank"]) for q, g in t.groupby("query_id")} == {q: [1, 2, 3, 4, 5] for q in ([0, 50, 100] if n == 2 else [0, 50, 100, 550])}
        assert (t["vec_id"] != t["query_id"]).all() and not t["vec_id"].isin([500, 600, 650]).any()


def test_op3(out, docs):
    types, t = out(3)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert ids(t) == Counter(d[0] for d in docs) and t["score"].between(0, 1).all() and set(t["lang_pred"]) == {"en", "de", "und"}
    for r in t.itertuples():
        assert r.held_out == (r.doc_id == r.doc_id and zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)
    assert set(t[t["lang_pred"] == "und"]["doc_id"]) == {300, 301, 302}


def test_op4(out, docs):
    types, t = out(4)
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    library = bpe.Vocabulary().library
    want = Counter((d[0], len((d[1] or "").encode()), len(library.encode(d[1] or "", add_special_tokens=False).ids)) for d in docs)
    assert Counter((None if i != i else int(i), b, n) for i, b, n in zip(t["doc_id"], t["n_bytes"], t["n_tokens"], strict=True)) == want
    assert (t["over_limit"] == (t["n_tokens"] > 1024)).all() and t["over_limit"].any()


def test_op5(out, docs):
    types, t = out(5)
    assert types == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    assert ids(t) == Counter(d[0] for d in docs) and (t["taken"] <= 3 * t["size"]).all()
    own = Counter()
    for d in docs:
        own[d[3]] += len((d[1] or "").split())
    names = sorted(own, key=lambda x: (x is None, x))
    target = dict(zip(names, mixing.capped_targets([own[n] for n in names], [1.0 + i % 3 for i in range(len(names))], 3), strict=True))
    assert {(n, round(x, 6)) for n, x in zip(t["source_size"], t["target"], strict=True)} == {(own[n], round(target[n], 6)) for n in names}
    by = t.groupby("source_size")["taken"].sum()
    for n in names:
        sizes = [len((d[1] or "").split()) for d in docs if d[3] == n]
        small, long = [x for x in sizes if x < 1000], [x for x in sizes if x >= 1000]
        reached = [sum(c) for c in itertools.product(*[[x * k for k in range(4)] for x in long])]  # what the long documents alone can give
        least = min(max(target[n] - x - 3 * sum(small), x - target[n], 0) for x in reached)
        assert abs(by[own[n]] - target[n]) <= least + max(small) + (sum(small) if long else 0), n  # what was drawn before a long document stays


def test_op6(out):
    types, t = out(6)
    assert types == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert sorted(t["page_id"]) == [1, 2, 2, 3] and (t["n_chars"] == t["text"].str.len()).all()
    assert t[t["page_id"] == 1]["text"].iloc[0].startswith("T\n\nA sentence") and (t[t["page_id"] > 1]["text"] == "").all()


def test_op7(out, docs):
    types, t = out(7)
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = Counter((d[0], f"{brute_print(d[1]):016x}") for d in docs)
    assert Counter((None if i != i else int(i), f) for i, f in zip(t["doc_id"], t["fingerprint"], strict=True)) == prints
    nodes = {}
    for i, f in prints:
        nodes.setdefault(int(f, 16), []).append(i)
    roots = brute_components({k: f for k, f in enumerate(nodes)})
    least = {}
    for k, f in enumerate(nodes):
        known = [i for i in nodes[f] if i is not None]
        least[roots[k]] = min([*known, *([least[roots[k]]] if least.get(roots[k]) is not None else [])], default=None)
    want = {f"{f:016x}": least[roots[k]] for k, f in enumerate(nodes)}
    assert all((None if c != c else int(c)) == want[f] for f, c in zip(t["fingerprint"], t["component_id"], strict=True))


def test_op8(out, docs):
    types, t = out(8)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert ids(t) == Counter(d[0] for d in docs) and t["score"].between(0, 1).all() and (t["predicted"] == (t["score"] >= 0.7)).all()
    held = t[t["held_out"] & (t["doc_id"] < 300)]
    assert all(zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in held["doc_id"])
    assert ((held["doc_id"] % 6 == 1) == (held["predicted"] == 1)).all()


def test_op10(out, docs):
    types, t = out(10)
    assert types == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    some = Counter(d[0] for d in docs)
    alone = {d[0]: d[1] for d in docs if d[0] is not None and some[d[0]] == 1}
    vocabulary = bpe.Vocabulary()
    for _, g in t.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
    mine = t[t["doc_id"].isin(list(alone))]
    check_packed(mine.assign(sequence_id=range(len(mine)), offset=0), alone, vocabulary, 1024)
    assert ids(t[t["piece"] == 0]) == some


def test_pipeline_with_clashing_names(spark, folder, docs):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, folder)
        assert kept.columns == frame.columns, name
        assert kept.count() > 0
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    clean = {d[0] for d in docs if d[1] and any(c.isalpha() for c in d[1])}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= clean

"""The pipeline's stages, each against brute force on its own input, and the whole against the stages."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph.llm import bpe, mixing, toxicity
from tests.llm.test_operators import brute_components, brute_print, check_packed
from tests.llm.test_toxicity import WORD, brute_model


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    en, de = "the river runs past an old garden wall under trees".split(), "der fluss läuft hinter einer alten mauer unter bäumen".split()
    rows, labels = [], []
    for i in range(240):
        words = rng.choice(de if i % 4 == 0 else en, 40).tolist()
        if i % 6 == 1:
            words[5:5] = ["idiotic", "moronic", "scummy"]
        rows.append((i, " ".join(words), "de" if i % 4 == 0 else "en", f"s{i % 3}" if i % 7 else None, 0))
        labels.append((i, 1, int(i % 6 == 1)))
    rows += [(300, None, None, "s1", 0), (301, "12 34 !", "en", "s1", 0), (302, "", "en", "s0", 0)]
    rows += [(400 + i, rows[2][1], "en", "s2", 0) for i in range(12)] + [(2, rows[2][1], "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plainly_clean(rows, labels):
    """Rows whose score is below 0.7, from the plain model and its own fit on the rows kept out of the counts."""
    crc = {r[0]: zlib.crc32(str(r[0]).encode()) for r in rows}
    learn = [r for r in rows if crc[r[0]] % 3 != 1 and r[0] in labels]
    held = [r for r in learn if crc[r[0]] // 3 % 5 == 0]
    counted = [r for r in learn if r not in held]
    ratio = brute_model([r[1] for r in counted], [labels[r[0]] for r in counted])

    def features(text):
        words = WORD.findall(text)
        total = sum(math.log(0.98 + 0.02 * math.exp(min(ratio(w), 50))) for w in words)
        return [1.0, 10 * total / max(len(words), 1), total / math.sqrt(max(len(words), 1))]

    weights = toxicity.fit_logistic(np.array([features(r[1]) for r in held]), np.array([float(labels[r[0]]) for r in held]))
    return [r for r in rows if 1 / (1 + math.exp(-np.dot(features(r[1]), weights))) < 0.7]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "mixture", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        before = [tuple(r) for r in docs.collect()]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, [tuple(r) for r in docs.collect()])
    before, after = seen["language"]
    assert Counter(after) == Counter(r for r in before if r[1] and any(c.isalpha() for c in r[1]))
    before, after = seen["toxicity"]
    assert Counter(after) == Counter(plainly_clean(before, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}))
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len(gone) >= 30 and all(i % 6 == 1 for i in gone)
    before, after = seen["near_dedup"]
    groups = brute_components({r[0]: brute_print(r[1]) for r in before})
    assert sorted(r[0] for r in after) == sorted(set(groups.values()))
    before, after = seen["mixture"]
    size, source = {r[0]: len(r[1].split()) for r in before}, {r[0]: r[3] for r in before}
    own = defaultdict(int)
    for i, n in size.items():
        own[source[i]] += n
    names = sorted(own, key=lambda x: (x is None, x))
    target = dict(zip(names, mixing.capped_targets([own[n] for n in names], [1.0 + i % 3 for i in range(len(names))], 3), strict=True))
    took = Counter(r[0] for r in after)
    assert max(took.values()) <= 3 and set(took) <= set(size)
    for n in names:
        words = sum(size[i] * k for i, k in took.items() if source[i] == n)
        assert abs(words - target[n]) <= max(size.values()) / 2 + 1
    before, _ = seen["packing"]
    places = docs.toPandas()
    assert Counter(places[places["piece"] == 0]["doc_id"]) == Counter(r[0] for r in before)
    once = places.drop_duplicates(["doc_id", "piece"])
    vocabulary = bpe.Vocabulary()
    for _, g in places.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
    alone = once.assign(sequence_id=range(len(once)), offset=0)
    check_packed(alone, {r[0]: r[1] for r in before}, vocabulary, 1024)
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, places[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

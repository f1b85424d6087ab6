"""The pipeline's near-duplicate stage on planted copies."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from ripplegraph.llm import neardup
from tests.llm.test_operators import DOCS


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def similarity(x, y):
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def brute(texts):
    """For each text the least index that it is joined with."""
    sets, head = [grams(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if head[a] != head[b] and similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((head[a], head[b]))
            head = [x if h == y else h for h in head]
    return head


@pytest.mark.parametrize("members, shingles", [(1000, 1 << 20), (2, 300)])
def test_edited_copies_go(spark, monkeypatch, members, shingles):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "SHINGLES", shingles)
    rng = np.random.default_rng(3)
    texts = []
    for n, changes in ((100, 1), (100, 2), (300, 2), (300, 5), (1000, 3), (100, 4), (60, 6)):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts += [" ".join(words), edited(rng, words, changes)]
    words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts += [edited(rng, words, int(rng.integers(2, 7))) for _ in range(60)]  # most pairs are less than near
    texts += ["a b c", "A  b c", "a b d", "", None]
    head = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)], DOCS).repartition(5)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(head))
    assert len(set(head[:48])) <= 26  # of the pairs of 0.82 and more nearly all are joined


def brute_links(nodes, roots, asks, sets):
    found = set()
    for i in np.flatnonzero(asks):
        for j in range(len(sets)):
            x, y = (set(np.frombuffer(sets[k], np.uint32).tolist()) for k in (i, j))
            if roots[i] != roots[j] and nodes[i] != nodes[j] and 10 * len(x & y) >= 8 * len(x | y):
                found.add((int(nodes[i]), int(roots[j])))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_rarest_shingles_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 400, int(rng.integers(1, 60))) for _ in range(5)]
    sets = []
    for _ in range(60):
        x = base[rng.integers(5)].copy()
        some = rng.random(len(x)) < rng.random() * 0.25
        x[some] = rng.integers(0, 4000, int(some.sum()))
        sets.append(np.unique(x.astype(np.uint32)).tobytes())
    nodes, roots, asks = np.arange(60), rng.integers(0, 20, 60), rng.random(60) < 0.5
    root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    got = neardup.near_pairs(nodes, roots, asks, sets)
    assert {(a, root[b]) for a, b in zip(*got, strict=True)} == brute_links(nodes, roots, asks, sets)


def test_texts_of_one_template_are_not_compared_pair_by_pair(monkeypatch):
    """Seventy words of a template and twenty of one's own: similarity below the limit, and next to no comparison."""
    compared = []
    some = neardup.in_common
    monkeypatch.setattr(neardup, "in_common", lambda mine, others: compared.append(len(others)) or some(mine, others))
    for n in (1000, 2000, 4000):
        rng = np.random.default_rng(n)
        template = rng.integers(0, 1 << 32, 66, dtype=np.uint32)
        sets = [np.unique(np.concatenate([template, rng.integers(0, 1 << 32, 24, dtype=np.uint32)])).tobytes() for _ in range(n)]
        compared.clear()
        assert neardup.near_pairs(np.arange(n), np.arange(n), np.ones(n, bool), sets) == ([], [])
        assert sum(compared) < n


def test_only_rows_of_a_group_replace_each_other(spark):
    a, b, c, d = ("the first text stands here alone", "another one says something else", "a third has its own words", "and a last one ends it")
    rows = [(None, a), (None, b), (None, b), (7, b), (7, c), (7, d), (9, d), (8, c), (8, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS).repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(0, a), (7, b), (7, c), (7, d), (0, "")])


def test_mixture_takes_rows_without_an_id_by_themselves(spark):
    texts = [f"text {i} " + "word " * (i % 7) for i in range(60)]
    docs = spark.createDataFrame([(None if i % 2 else 4, t, "en", "s", 1, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    out = [r["text"] for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert sorted(out) == sorted(texts)  # one source: each once

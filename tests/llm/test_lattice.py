"""Scores of the subword lattice against plain versions: all spellings of a word, counts, and a text's probability."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import lattice as L

SCHEMA = "doc_id long, text string, score string, n string, c string"


def spelled(word, p):
    """Sum over all ways to cut the word, by recursion."""
    if not word:
        return 1.0
    return sum(p[word[:n]] * spelled(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    units = [bytes([b]) for b in range(256)] + [b" ab", b" abc", b"bc", b"cab", b"abcabcabc", b"abcabcabcabcabca", "é".encode(), b" a"]
    p = rng.random(len(units))
    return units, p / p.sum()


def test_sum_over_all_spellings(small):
    units, p = small
    known = dict(zip(units, p, strict=True))
    words = [b"abc", b"", b"a", b"bcabc", "abécab".encode(), b"abcabcabcab", b"cabcabcab"]
    assert np.allclose(np.exp(L.Lattice(units, p).spelled(words)), [spelled(b" " + w, known) for w in words], rtol=1e-9)


def test_long_words_are_spelled_like_short_ones(small, monkeypatch):
    units, p = small
    words = [b"abc" * n for n in range(1, 30)] + [b"x" * 40, b"ab" * 20]
    a, b = np.zeros(len(units)), np.zeros(len(units))
    batch = L.Lattice(units, p).spelled(words, a)
    monkeypatch.setattr(L, "WIDE", 0)
    assert np.allclose(batch, L.Lattice(units, p).spelled(words, b)) and np.allclose(a, b)
    assert np.isclose(sum(e * len(u) for e, u in zip(a, units, strict=True)), sum(len(w) + 1 for w in words))  # a spelling's units hold the word


def test_expected_counts_raise_the_likelihood(spark, small):
    units, p = small
    words = ["abc", "abcab", "cabc", "bcab"] * 3
    one, two = (L.refined(spark.createDataFrame([(w,) for w in words], "word string"), units, p, n) for n in (1, 3))
    logs = [x.spelled([w.encode() for w in words]).sum() for x in (L.Lattice(units, p), one, two)]
    assert logs[0] < logs[1] < logs[2] and np.isclose(np.exp(two.log[:-1]).sum(), 1)


def test_existing_vocabulary():
    units, p = L.existing_units()
    assert len(set(units)) == len(units) > 20_000 and np.isclose(p.sum(), 1) and (p > 0).all()
    assert {bytes([b]) for b in range(256)} <= set(units) and not any(65 <= b <= 90 for u in units if len(u) > 1 for b in u)


def test_passages():
    stop = next(w for w in (f"w{i}.".encode() for i in range(99)) if zlib.crc32(w) % L.EVERY == 0)
    assert L.passages([]) == [(0, 0)] and L.passages([b"a", stop]) == [(0, 2), (2, 2)] and L.passages([stop, b"a"]) == [(0, 1), (1, 2)]
    assert L.passages([b"a"] * (L.LONGEST + 1)) == [(0, L.LONGEST), (L.LONGEST, L.LONGEST + 1)]


def discount(counts):
    n = Counter(counts.values())
    return min(max(n[1] / max(n[1] + 2 * n[2], 1), 0.1), 0.95)


def plain(rows, learned):
    """(n_tokens, n_known, N, base, score) of each row."""
    low = lambda t: [w.encode() for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().decode().split(" ") if w]
    cut = lambda t: [(tuple(w[a:b]), i == len(L.passages(w)) - 1) for w in [low(t)] for i, (a, b) in enumerate(L.passages(w))]
    words, runs = Counter(), Counter()
    for _, t in learned:
        words.update([*low(t), b"\n"])
        runs.update(cut(t))
    total, kinds = sum(words.values()), len(words)
    units, p = L.existing_units()
    types = [w for w in words if w != b"\n"]
    for _ in range(L.ROUNDS):
        e = np.full(len(units), 0.0)
        L.Lattice(units, p).spelled(types, e)
        p = (e + 0.01) / (e + 0.01).sum()
    lattice, held = L.Lattice(units, p), (discount(words), discount(runs))
    rest = held[0] * kinds / total if total else 1.0, held[1] * len(runs) / sum(runs.values()) if runs else 1.0

    def word(w):
        q = (1 / (kinds + 1) if kinds else 0.5) if w == b"\n" else math.exp(lattice.spelled([w])[0]) * (kinds / (kinds + 1) if kinds else 0.5)
        return max(words[w] - held[0], 0) / max(total, 1) + rest[0] * q

    out = []
    for _, t in rows:
        tokens = [*low(t), b"\n"]
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        score = 0.0
        for run, last in cut(t):
            spelled_ = sum(math.log10(word(w)) for w in [*run, *([b"\n"] if last else [])]) + math.log10(rest[1])
            own = math.log10((runs[run, last] - held[1]) / sum(runs.values())) if runs[run, last] else -math.inf
            top = max(own, spelled_)
            score += top + math.log10(10 ** (own - top) + 10 ** (spelled_ - top))
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), total, base, score))
    return out


@pytest.mark.parametrize("hot", [5, 500_000])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rng = np.random.default_rng(8)
    vocabulary = ["The", "river", "runs.", "Übers", "zzq", "old", "wall.", "gar", "den", "日本", "a", "b!"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90))))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "the river runs. " * 400), (93, "q" * 300 + " unseenword"), (None, "The wall."), (7, rows[7][1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    got = sorted(tuple(r) for r in L.lattice_scores(frame, "doc_id", "text", learn).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    want = sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, plain(rows, [r for r in rows if r[0] is not None and r[0] % 3 != 1]), strict=True))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-6)  # a rare word's score travels as a float


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some words", "", "", ""), (2, None, "", "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in L.lattice_scores(frame, "doc_id", "text", F.lit(False)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0.0 and -40 < got[1]["score"] < got[2]["score"] < 0
    assert L.lattice_scores(frame.limit(0), "doc_id", "text", F.lit(True)).count() == 0


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    from ripplegraph.llm import queries

    rows = queries()["op11_subword_lattice"](spark, "/root/testdata/sf0.1").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == 10_000 and held["score"].sum() > held["base_score"].sum()

"""The toxicity models against a plain spelling of the same formulas."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ripplegraph.llm import toxicity
from tests.llm.test_operators import DOCS

WORD = re.compile(r"[^\W\d_]+")


def brute_model(texts, toxic):
    """Log ratio of a word, from dictionaries of word beginnings."""
    n, docs = (Counter(), Counter()), Counter()
    for text, y in zip(texts, toxic, strict=True):
        words = Counter(w + "$" for w in WORD.findall(text.lower()))
        for w, k in words.items():
            for i in range(1, len(w) + 1):
                n[y][w[:i]] += k
                docs[w[:i]] += 1
    held = []
    for c in n:
        one, two = (sum(v == k for v in c.values()) for k in (1, 2))
        held.append(min(max(one / max(one + 2 * two, 1), 0.1), 0.95))
    below = defaultdict(list)
    for p in docs:
        below[p[:-1]].append(p)

    def p(y, context, events):
        """Probability of some letters in a context; None stands for letters that nobody has seen there."""
        total = sum(n[y][e] for e in below[context])
        back = sum(min(n[y][e], held[y]) for e in below[context]) / total
        both = sum(docs[e] for e in below[context]) + 1
        return sum(max(n[y][e] - held[y], 0) / total + back * docs[e] / both if e else back / both for e in events)

    def ratio(word):
        out, context = 0.0, ""
        for letter in word.lower() + "$":
            if not all(any(n[y][e] for e in below[context]) for y in (0, 1)):
                break
            seen = n[1][context + letter] > 0
            events = [context + letter] if seen else [None, *(e for e in below[context] if not n[1][e])]
            out += math.log(p(1, context, events)) - math.log(p(0, context, events))
            if not seen:
                break
            context += letter
        return out

    return ratio


def corpus(n=240):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(60)]
    texts, toxic = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        some = rng.choice(words, 25).tolist() + (["badword" + str(rng.choice(["x", "yz", ""])), "nasty"] if y else [])
        texts.append(" ".join(rng.permutation(some)) + ".")
        toxic.append(y)
    return texts, toxic


def table(spark, texts, toxic):
    made = toxicity.counts(pa.array(texts), np.array(toxic))
    frame = spark.createDataFrame(pd.DataFrame(dict(zip(("key", "before", "toxic", "ordinary", "docs"), made, strict=True))))
    return toxicity.kneser_ney(frame)


def test_ratios_are_those_of_the_formulas(spark):
    texts, toxic = corpus()
    found = table(spark, texts, toxic).toPandas()
    model = toxicity.Model(found["key"].to_numpy(np.int64).view(np.uint64), found["cond"].to_numpy(), found["back"].to_numpy())
    ratio = brute_model(texts, toxic)
    asked = sorted({w for t in texts for w in WORD.findall(t)}) + ["badwordy", "badwo", "nastily", "zebra", "a", "ab" * 40, "q"]
    (words,) = toxicity.words(pa.array([" ".join(asked)]))
    spelled = ["".join(map(chr, words.codes[a:b])) for a, b in zip(words.begin, words.end, strict=True)]
    assert "".join(spelled) == "".join(asked)
    assert np.allclose(model.ratios(words), [ratio(w) for w in spelled], atol=1e-4)
    value = toxicity.evidence(np.array([ratio(w) for w in WORD.findall(texts[0])])).sum()
    assert np.allclose(model.evidence(pa.array(texts[:1]))[0], value, atol=1e-4)


def test_a_model_too_large_to_ship_gives_the_same_scores(spark):
    texts, toxic = corpus()
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)] + [(900, None, "en", "s", 1, "x"), (901, "", None, "s", 1, "x"), (None, texts[0], None, "s", 1, "x"), (0, texts[0], None, "s", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.toxicity(docs, labels, ["doc_id", "text"], most_shipped=m).toPandas().sort_values(["doc_id", "text"]) for m in (0, 10**9))
    assert len(a) == len(rows) and np.allclose(a["score"], b["score"], atol=1e-6) and (a["predicted"].to_numpy() == b["predicted"].to_numpy()).all()


def test_words_hold_every_letter():
    texts = ["Ein Satz, mit 12 Wörtern!", "漢字かな交じり文と latin混ぜ", "x" * 200 + " y", "", None, "𞤀𞤣𞤤𞤢𞤥 ab"]
    for w in toxicity.words(pa.array(texts)):
        for i, t in enumerate(texts):
            seen = {p for a, b, x in zip(w.begin, w.end, w.text, strict=True) if x == i for p in range(a, b)}
            start = sum(len((x or "").lower()) + 1 for x in texts[:i])
            assert {start + j for j, c in enumerate((t or "").lower()) if c.isalpha()} == seen
        assert ((w.end - w.begin) <= toxicity.RUN).all()


@pytest.mark.parametrize("text", ["这是一个笨蛋吗", "说他是笨蛋没错"])
def test_expressions_in_text_without_spaces(spark, text):
    rng = np.random.default_rng(3)
    letters = list("这是一个很好的天气我们去公园看花和树山水人说他没错吗")
    texts = ["".join(rng.choice(letters, 12)) for _ in range(200)]
    texts = [t[:5] + "笨蛋" + t[5:] if i % 4 == 0 else t for i, t in enumerate(texts)]
    found = table(spark, texts, [int(i % 4 == 0) for i in range(200)]).toPandas()
    model = toxicity.Model(found["key"].to_numpy(np.int64).view(np.uint64), found["cond"].to_numpy(), found["back"].to_numpy())
    assert model.evidence(pa.array([text]))[0][0] > model.evidence(pa.array([text.replace("笨蛋", "天气")]))[0][0] + 0.1


def test_rows_that_are_not_fitted_on_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_FITTED", 10)
    crc = [zlib.crc32(str(i).encode()) for i in range(900)]
    rare = [i for i in range(900) if crc[i] % 3 != 1 and crc[i] // 3 % 5 == 0]  # the fifth that the fitted rows come from
    rows = [(i, "river garden stone " + ("scummy" if i in rare else "idiotic" if i % 5 == 0 else "paper"), "en", "s", 1, "x") for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i in rare or i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    trained = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    asked = spark.createDataFrame([(0, "a scummy river"), (1, "a paper river")], "doc_id long, text string")
    score = {r["doc_id"]: r["__sum"] for r in toxicity.with_scores(asked, trained, ["doc_id"]).collect()}
    assert score[0] > 0 > score[1]


def test_held_out_documents(spark):
    """Recall and false positives on the test data's held-out rows; some toxic documents there hold no learnable expression."""
    folder = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and dict(out.dtypes)["predicted"] == "int"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = out.filter("held_out").join(labels, "doc_id").toPandas()
    bad = found["toxic"] == 1
    assert found[bad]["predicted"].mean() > 0.7 and found[~bad]["predicted"].mean() < 0.015

"""The decision by language against exact sets, and languages with next to no text."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph.llm import langid

SCHEMA = "doc_id long, text string, lang string"
GREEK = "ο ποταμός περνά δίπλα από τον παλιό κήπο"
TEXTS = {
    "en": "the river runs past an old garden wall under trees in spring rain and nobody knows where it ends",
    "de": "der fluss läuft hinter einer alten mauer unter bäumen im regen dahin und niemand weiß wo er endet",
    "fr": "la rivière coule derrière un vieux mur sous les arbres au printemps et personne ne sait où elle finit",
}


def learned(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 != 0


def rows_of(seed, count):
    rng = np.random.default_rng(seed)
    names = list(TEXTS)
    return [(i, " ".join(rng.choice(TEXTS[names[i % 3]].split(), int(rng.integers(3, 30)))), names[i % 3]) for i in range(count)]


def grams(text):
    """4-grams of the lower-cased letters, all between two words one blank, two blanks around the text."""
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    out = "  " + " ".join(out.split()) + "  "
    return [g for g in (out[i : i + 4] for i in range(len(out) - 3)) if g.strip()]


@pytest.mark.parametrize("much", [50, 100_000])
def test_decision_is_that_of_exact_sets(spark, monkeypatch, much):
    monkeypatch.setattr(langid, "MUCH", much)
    rows = rows_of(4, 300)
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if learned(i):
            counts[lang].update(grams(text))
    total = {k: sum(c.values()) for k, c in counts.items()}
    own = {}
    for k, c in counts.items():
        rate = lambda g: sum(counts[x][g] / total[x] for x in counts)
        own[k] = {g for g, n in c.items() if n / total[k] * (1 + 1e-9) >= langid.SHARE * rate(g) and (n >= 2 or total[k] < much)}
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(frame, ["doc_id"]).collect()}
    sure = 0
    for i, text, _ in rows:
        hits = {k: sum(g in own[k] for g in grams(text)) for k in own}
        first, second, *_ = sorted(hits.values(), reverse=True)
        if first - second > 2:  # filters may err by a few
            sure += 1
            assert got[i]["lang_pred"] == max(hits, key=hits.get)
            assert got[i]["score"] == pytest.approx(first / sum(hits.values()), abs=0.1)
    assert sure > 250


def test_a_language_of_one_short_document(spark):
    tiny = next(i for i in range(1000, 1100) if learned(i))
    rows = rows_of(5, 400) + [(tiny, GREEK, "el"), (2000, GREEK, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(frame, ["doc_id"]).collect()}
    assert got[tiny]["lang_pred"] == got[2000]["lang_pred"] == "el" and got[2000]["score"] > 0.9
    assert all(got[i]["lang_pred"] == lang for i, text, lang in rows[:400] if len(text.split()) > 8)


def test_the_pipeline_keeps_small_languages(spark):
    tiny = next(i for i in range(5001, 5100) if learned(i))
    rows = rows_of(6, 200) + [(tiny, GREEK, "el"), (6002, "12 34", "en"), (6003, None, "en")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, frame, "").collect()}
    assert kept == {r[0] for r in rows} - {6002, 6003}

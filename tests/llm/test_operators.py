"""Operators on small tables, against brute force, and with nulls, empty tables, ties and extra columns."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ripplegraph.llm import bpe, htmltext, langid, mixing, packing, sharding, simhash, tokencount, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, shard int, size string"
LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog {i * 7}", "en", f"s{i % 3}", 1, "x") for i in range(60)]
    rows += [(100, None, "en", None, 1, "x"), (101, "", None, "s1", 1, "x"), (102, " \n\t ", "de", "s9", 1, "x"), (103, LONG, "en", "s0", 1, "x"), (None, "ohne nummer", "de", "s0", 1, "x")]
    rows += [(5, rows[5][1], "en", "s2", 1, "x")] * 2 + [(200 + i, "der schnelle braune fuchs springt über den faulen hund " * (i + 1), "de", "s1", 1, "x") for i in range(20)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_jump_moves_rows_into_the_new_shard_only():
    keys = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    for n in (1, 2, 7, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.min() >= 0 and a.max() < n
        assert ((a == b) | (b == n)).all()
    assert np.bincount(sharding.jump(keys, 40), minlength=40).min() > 50


def test_shards(docs, empty):
    out = sharding.shard_rows(docs, ["doc_id"], 7, ["doc_id", "text"]).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out.groupby(out["doc_id"].fillna(-1))["shard"].nunique() == 1).all()
    assert sharding.shard_rows(empty, ["doc_id"], 7, ["doc_id"]).count() == 0


def brute_ids(text):
    return bpe.Vocabulary().library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def test_encoder_is_the_library(vocabulary):
    assert vocabulary.proven and len(vocabulary.whole) > 40_000
    rng = np.random.default_rng(3)
    bits = [" ", "  ", "\n", "\t", "a", "Hello", "'s", "é", "12", ".", "!?", "\xa0", "<|endoftext|>", "漢", "か", "’", "\x85", "\x1c", "𝕏", "ß", " \n", "don't", "x" * 300, "ⅷ", "²"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(3000)] + ["", None]
    want = [vocabulary.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    counts = np.concatenate([s for s, _ in bpe.Encoder(vocabulary, False).slices(pa.array(texts))])
    assert counts.tolist() == [len(w) for w in want]
    made = list(bpe.Encoder(vocabulary, True).slices(pa.array(texts)))
    assert np.concatenate([f for _, f in made]).tolist() == [i for w in want for i in w]


def test_equal_hashes_are_told_apart(vocabulary, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in (3, 7, 8, 9, 16, 17, 40, 128) for _ in range(6)]
    words += [w[:-1] + "z" for w in words] + ["z" + w[1:] for w in words]
    texts = [" ".join(rng.choice(words, 9)) for _ in range(200)]
    want = [vocabulary.library.encode(t, add_special_tokens=False).ids for t in texts]
    some = bpe.ChunkTable.hashes
    monkeypatch.setattr(bpe.ChunkTable, "hashes", lambda *a: some(*a) % np.uint64(3) + np.uint64(1))
    counts = np.concatenate([s for s, _ in bpe.Encoder(vocabulary, False).slices(pa.array(texts))])
    assert counts.tolist() == [len(w) for w in want]
    made = list(bpe.Encoder(vocabulary, True).slices(pa.array(texts)))
    assert np.concatenate([f for _, f in made]).tolist() == [i for w in want for i in w]


def test_long_texts_are_the_library(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 300)
    rng = np.random.default_rng(5)
    bits = ["  ", " \n ", "   ", "\t", "word", " Hello", "don't", " é ", "12", "\xa0 ", " 漢字", ".", " the", " quick"]
    texts = ["".join(rng.choice(bits, 900)) for _ in range(30)] + ["x" * 2000, " " * 2000, "a<|endoftext|> b" * 90]
    want = [vocabulary.library.encode(t, add_special_tokens=False).ids for t in texts]
    made = list(bpe.Encoder(vocabulary, True).slices(pa.array(texts)))
    assert [int(n) for s, _ in made for n in s] == [len(w) for w in want]
    assert np.concatenate([f for _, f in made]).tolist() == [i for w in want for i in w]
    counts = np.concatenate([s for s, _ in bpe.Encoder(vocabulary, False).slices(pa.array(texts))])
    assert counts.tolist() == [len(w) for w in want]


def test_full_table_is_cleared(vocabulary, monkeypatch):
    e = bpe.Encoder(vocabulary, True)
    e.table.most = 50
    texts = [" ".join(f"w{i}q{j}" for j in range(8)) for i in range(40)]
    monkeypatch.setattr(bpe, "SLICE", 200)
    made = list(e.slices(pa.array(texts)))
    assert np.concatenate([f for _, f in made]).tolist() == [i for t in texts for i in vocabulary.library.encode(t).ids]


def test_token_counts(docs, empty, vocabulary):
    out = tokencount.token_counts(docs, "text", ["doc_id", "text"], 1024).toPandas()
    for r in out.itertuples():
        assert r.n_tokens == len(vocabulary.library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024)
    assert tokencount.token_counts(empty, "text", ["doc_id"], 1024).count() == 0


def check_packed(out, texts, vocabulary, capacity):
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= capacity
    pieces = {}
    for r in out.itertuples():
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*vocabulary.library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == capacity for r in mine[1:]) and (len(ids) > capacity or len(mine) == 1)
        for r in mine:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_packing(docs, empty, vocabulary):
    once = docs.filter("doc_id is not null and doc_id <> 5")
    out = packing.pack(once, "text", ["doc_id"], capacity=64).toPandas()
    check_packed(out, {r["doc_id"]: r["text"] for r in once.collect()}, vocabulary, 64)
    assert out["sequence_id"].nunique() <= 1.02 * -(-out["length"].sum() // 64) + 1
    assert len(packing.pack(docs, "text", ["doc_id"], capacity=64).filter("doc_id = 5").collect()) == 3
    assert packing.pack(empty, "text", ["doc_id"]).count() == 0


@pytest.mark.parametrize("low,high", [(1, 1024), (300, 1024), (342, 700)])
def test_plans_are_whole_and_close(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 4000)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    made = packing.best_plan(histogram, 1024)
    used, placed = {}, {}
    for s, first, n, at, offset in sorted(made.runs, key=lambda r: r[4]):
        placed[s] = placed.get(s, 0) + n
        for b in range(at, at + n):
            assert used.get(b, 0) == offset
            used[b] = offset + s
    assert placed == histogram and max(used.values()) <= 1024
    plain = packing.Plan(1024)
    for s in sorted(histogram, reverse=True):
        plain.best_fit(s, histogram[s])
    assert made.bins <= 1.02 * plain.bins


def test_targets():
    t = mixing.capped_targets([100, 100, 1], [1, 2, 3], 3)
    assert t[2] == 3 and abs(sum(t) - 201) < 1e-9 and abs(t[1] - 2 * t[0]) < 1e-9
    assert mixing.capped_targets([], [], 3) == [] and mixing.capped_targets([0], [1], 3) == [0]


def brute_flow(sizes, targets, repeats):
    """Most words, then least cost, over all whole flows."""
    arcs = [(p, s) for p in sizes for s in p]
    best = None
    for amounts in itertools.product(*[range(int(repeats * sizes[p]) + 1) for p, _ in arcs]):
        by_p, by_s = {}, {}
        for (p, s), a in zip(arcs, amounts, strict=True):
            by_p[p], by_s[s] = by_p.get(p, 0) + a, by_s.get(s, 0) + a
        if any(by_p[p] > repeats * sizes[p] for p in by_p) or any(by_s[s] > targets[s] for s in by_s):
            continue
        cost = sum(sum((k // sizes[p]) ** 2 for k in range(n)) for p, n in by_p.items())
        if best is None or (-sum(amounts), cost) < best:
            best = (-sum(amounts), cost)
    return best


@pytest.mark.parametrize("sizes,targets", [({("a",): 2, ("a", "b"): 2}, {"a": 3, "b": 3}), ({("a", "b"): 1, ("b", "c"): 2}, {"a": 2, "b": 1, "c": 3}), ({("a",): 3}, {"a": 8})])
def test_flow_is_the_cheapest(sizes, targets):
    flow = mixing.route(sizes, targets, 3)
    n = {p: sum(f.values()) for p, f in flow.items()}
    cost = sum(sum((k // sizes[p]) ** 2 for k in range(m)) for p, m in n.items())
    assert (-sum(n.values()), cost) == brute_flow(sizes, targets, 3)


def test_mix(spark, docs, empty):
    from pyspark.sql import functions as F

    out = mixing.mix(docs, F.array("source"), mixing.words(F.col("text")), ["doc_id"]).toPandas()
    assert len(out) == docs.count()
    assert (out["taken"] <= 3 * out["size"]).all() and ((out["size"] == 0) | (out["taken"] % out["size"].where(out["size"] > 0, 1) == 0)).all()
    again = mixing.mix(docs.repartition(3), F.array("source"), mixing.words(F.col("text")), ["doc_id"]).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    rows = [(i, ["a", "b", None][i % 3], 10 + i % 7) for i in range(3000)]
    even = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(even, F.array("source"), F.col("n"), ["doc_id"]).join(even.select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby(got["source"].fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 8).all() and by.loc["~", "target"] > by.loc["b", "target"] > by.loc["a", "target"]
    assert mixing.mix(empty, F.array("source"), mixing.words(F.col("text")), ["doc_id"]).count() == 0


@pytest.mark.parametrize("ordered", [10_000, 2])
def test_mix_of_repeated_rows(spark, monkeypatch, ordered):
    """A source with most of its rows equal, one of null ids, and rows that differ in nothing that is drawn by."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "ORDERED", ordered)
    rows = [(7, "w " * 45, "a", "x")] * 60 + [(i, "w " * (5 + i % 9), "a", "x") for i in range(100, 130)]
    rows += [(None, "w " * (3 + i % 11), "b", "y") for i in range(300)] + [(None, "w w w", "c", "y")] * 200 + [(900, "", "c", "z"), (901, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(docs.repartition(3), F.array("source"), mixing.words(F.col("text")), ["doc_id", "source", "text"], by=["doc_id", "source", "text"]).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
    for source, g in out[out["size"] > 0].groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= (23 if source == "a" else 2), source
    again = mixing.mix(docs.repartition(5), F.array("source"), mixing.words(F.col("text")), ["doc_id", "source", "text"], by=["doc_id", "source", "text"]).toPandas()
    assert sorted(map(str, out.values.tolist())) == sorted(map(str, again.values.tolist()))


def test_words(spark):
    from pyspark.sql import functions as F

    texts = [" a  b\tc ", "", None, "a\x0bb\x0cc\x1cd\x85e", "é \xa0 x", "\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len((t or "").encode().split()) for t in texts]


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_words_within_two_bits_share_a_codeword():
    error, _, _ = simhash.decoder()
    near = np.array([0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(23), 2))])
    row, index = simhash.near_codewords(error)
    own = [set() for _ in error]
    for r, i in zip(row.tolist(), index.tolist(), strict=True):
        own[r].add(i)
    for k, e in enumerate(error):
        row, index = simhash.near_codewords(e ^ near)
        ok = np.zeros(len(near), bool)
        ok[row[np.isin(index, list(own[k]))]] = True
        assert ok.all()


def test_keys_meet_for_all_flips():
    fp = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 3)
    for f in fp:
        flips = [(np.uint64(1) << np.uint64(i)) | (np.uint64(1) << np.uint64(j)) for i, j in itertools.combinations(range(64), 2)]
        other = (np.array([f]).view(np.uint64) ^ np.array(flips, np.uint64)).view(np.int64)
        row, key = simhash.keys_of(np.concatenate([[f], other]))
        mine = key[row == 0]
        hit = np.zeros(len(other) + 1, bool)
        hit[row[np.isin(key, mine)]] = True
        assert hit.all()


@pytest.mark.parametrize("few,together", [(32, 50_000), (1, 50_000), (1, 2)])
def test_links_whatever_the_bucket(spark, monkeypatch, few, together):
    monkeypatch.setattr(simhash, "PAIRWISE", few)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    prints = {int(b) for b in base}
    for b in base:
        at = int(b) & (2**64 - 1)
        for _ in range(25):
            at ^= 1 << int(rng.integers(64))
            at ^= (1 << int(rng.integers(64))) if rng.random() < 0.5 else 0
            prints.add(at - (1 << 64) if at >> 63 else at)
    prints |= {0, 3, -1}
    from ripplegraph.llm.components import components

    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links_of(nodes)).collect()}
    want = brute_components({p: p & (2**64 - 1) for p in prints})
    assert {p: got.get(p, p) for p in prints} == want


def test_simhash(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()]
    rng = np.random.default_rng(4)
    words = " ".join(f"w{i}" for i in range(400)).split()
    for i in range(40):
        w = list(words)
        for _ in range(i % 4):
            w[int(rng.integers(400))] = "CHANGED"
        rows.append((1000 + i, " ".join(w)))
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").collect()}
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    assert got == {(i, p - (1 << 64) if p >> 63 else p): want[i] for i, p in prints.items()}
    assert want[101] == want[100] == 100  # no words: fingerprint zero, linked
    assert simhash.near_duplicates(empty, "text", "doc_id").count() == 0


def test_language(spark, docs, empty):
    out = langid.identify(docs, ["doc_id", "text", "lang"]).toPandas()
    assert len(out) == docs.count()
    assert (out[out["text"].fillna("").str.strip() == ""]["lang_pred"] == "und").all()
    real = out[(out["text"].fillna("").str.strip() != "") & out["lang"].notna()]
    assert (real["lang_pred"] == real["lang"]).mean() > 0.95
    assert out["score"].between(0, 1).all() and (out["held_out"] == out["doc_id"].map(lambda i: i == i and zlib.crc32(str(int(i)).encode()) % 5 == 0)).all()
    assert langid.identify(empty, ["doc_id"]).count() == 0
    blank = langid.identify(docs.withColumn("lang", docs["lang"].substr(99, 1)).replace("", None, ["lang"]), ["doc_id"])
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}


def test_many_languages_and_false_positives():
    rng = np.random.default_rng(2)
    names = [f"l{i:03d}" for i in range(130)]
    packed = rng.integers(1, 2**62, 130 * 50).astype(np.uint64)
    f = langid.build(names, np.repeat(np.arange(130), 50), packed, np.full(130, 150.0))
    bits = f.lookup(packed)
    mine = np.repeat(np.arange(130), 50)
    assert all(bits[i, m // 64] >> np.uint64(m % 64) & np.uint64(1) for i, m in enumerate(mine))
    assert (f.false < 0.01).all()


def test_filters_grow_with_the_n_grams():
    packed = np.random.default_rng(2).integers(1, 2**62, 300_000).astype(np.uint64)
    f = langid.build(["a", "b"], np.arange(300_000) % 2, packed, np.array([1.0, 2.0]))
    assert len(f.words) == 1 << 21 and (f.false < 0.02).all()


def test_letters_of_all_planes(spark):
    adlam, ext = "𞤀𞤣𞤤𞤢𞤥 𞤆𞤵𞤤𞤢𞤪", chr(0x20020) * 4
    rows = [(i, f"{adlam} {i}", "ff", "s", 1, "x") for i in range(30)] + [(100 + i, f"some plain english words {i}", "en", "s", 1, "x") for i in range(30)]
    rows += [(200 + i, f"{ext} {i}", "zh", "s", 1, "x") for i in range(30)] + [(300, "12 34", "en", "s", 1, "x"), (301, "ꙮ", None, "s", 1, "x")]
    out = langid.identify(spark.createDataFrame(rows, DOCS), ["doc_id", "lang"]).toPandas().set_index("doc_id")
    known = out[out.index < 300]
    assert (known["lang"] == known["lang_pred"]).all() and (known["score"] > 0.5).all()
    assert out.loc[300, "lang_pred"] == "und" and out.loc[301, "lang_pred"] in ("en", "ff", "zh") and out.loc[301, "score"] == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, ["doc_id", "lang"]).filter("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(6)
    plain, bad = ["table", "window", "river", "garden", "music", "paper", "stone"], ["idiotic", "moronic", "scummy"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = rng.choice(plain, 30).tolist() + (rng.choice(bad, 3).tolist() if toxic else [])
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 1, "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, 1, "x"), (1001, "", None, None, 1, "x"), (None, "an idiotic river", None, None, 1, "x")]
    labels += [(5, 0, None), (None, 0, 1), (7, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels, ["doc_id"]).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all()
    held = out[out["held_out"]]
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1)).all()
    assert ((held["doc_id"] % 5 == 0) & (held["doc_id"] < 900) == (held["predicted"] == 1)).mean() > 0.97
    assert toxicity.toxicity(empty, labels, ["doc_id"]).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0), ["doc_id"]).filter("predicted = 1").count() == 0


PROSE = "Long text stands here in full sentences. " * 8


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>A &lt;b&gt;\n b</p><p>{PROSE}<br>x<p>Be.</article><footer>c</footer>", f"T\n\nA <b> b\n\n{PROSE}x\n\nBe."),
        (f"<div class='menu'><a>a</a></div><div><h1>T</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div id=comments><p>{PROSE}</p></div>", f"T\n\n{PROSE.strip()}\n\nShort.\n\n{PROSE.strip()}"),
        (f"<p>{PROSE}</p><script>var a='<p>{PROSE}</p>';</script><style>p{{}}</style><form><p>{PROSE}</p></form><!-- <p>no</p> -->", PROSE.strip()),
        (f"<main><article><p>{PROSE}</p><figure><img src=x><figcaption>Seen from above</figcaption></figure></article><article class='comment odd'><p>{PROSE}</p></article></main>", f"{PROSE.strip()}\n\nSeen from above"),
        ("<ul>" + "<li><a href=x>some longer link text here</a></li>" * 9 + f"</ul><p>{PROSE}</p><p>x", PROSE.strip()),
    ],
)
def test_main_text(page, want):
    assert htmltext.main_text(page).removesuffix("\n\nx") == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}é</p></article>", "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["n_chars"]) for r in htmltext.extract(pages, "html", ["page_id", "url"]).collect())
    assert got == [(1, len(PROSE) + 1), (2, 0), (2, 0)]
    assert htmltext.extract(pages.limit(0), "html", ["page_id"]).count() == 0

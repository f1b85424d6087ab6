"""Toxicity by two class-conditional Kneser-Ney models.

The toxic and the ordinary model spell a word letter by letter, to its end; the context of a letter is all that
stands before it in the word. Each class gives a letter its absolutely discounted count in that context, with the
Kneser-Ney discount n1 / (n1 + 2 n2), and what is held back goes to one shared distribution: the continuation
counts of both classes together, which count a word once for each document that holds it, and one more for letters
that nobody has seen there. So a rare expression counts only as far as its class counts differ. Letters that no toxic text
has in a context are one event of either class, with the shared distribution inside; so an unseen word counts by the
longest beginning that toxic texts know, and the model holds no more than the words of toxic texts. Below a beginning
that not both classes know both models are the shared one.

A toxic document is mostly ordinary speech, so the toxic likelihood of a word is that of a mixture, a part
``INSULTS`` of it from the toxic model and the rest from the ordinary one. A text's evidence is the difference of
both log-likelihoods by length (and by its square root, the scale on which chance adds up); the score is a logistic
function of it, fitted on labelled rows that the counts don't hold.

Words are runs of letters. In scripts without spaces each letter begins a word of up to ``UNSPACED`` letters;
runs of more than ``RUN`` letters are read as several words. No letter is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_buffers, crc_of_id, drawn, forget, letters, map_texts, materialize, pieces, read, release_memory, small_batches

UNSPACED, RUN = 4, 64
INSULTS = 0.02  # part of a toxic document's words that come from the toxic model
ROOT = 0x243F6A8885A308D3  # key of the empty beginning
SLICE = 1 << 19  # bytes handled at once
MOST_SHIPPED = 4_000_000  # letters in context up to which the model is broadcast (64 MB); a larger one is joined to the words
MOST_MET = 500_000  # words whose evidence a worker remembers; then it begins anew
MOST_LABELS = 5_000_000  # labels up to which they are broadcast
MOST_FITTED = 50_000  # rows, about, that the logistic function is fitted on
SCRIPTS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))  # without spaces


@dataclass
class Words:
    """All words of some texts: their letters' code points, from ``begin`` to ``end``, and the text that each is in."""

    codes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    texts: int

    def letter(self, i: int, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key with letter ``i``, whether the word ends there) of the words ``at``, from the key before it."""
        place = self.begin[at] + i
        whole = place >= self.end[at]
        code = np.where(whole, 0, self.codes[np.minimum(place, len(self.codes) - 1)]).astype(np.uint64)
        key = (before ^ code) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(29)), whole

    def spelled(self):
        """(words, key with the letter, key before it, whether that ends the word), letter by letter."""
        i, at, before = 0, np.arange(len(self.begin)), np.full(len(self.begin), ROOT, np.uint64)
        while len(at):
            key, whole = self.letter(i, at, before)
            yield at, key, before, whole
            i, at, before = i + 1, at[~whole], key[~whole]

    def keys(self) -> np.ndarray:
        """A key of each whole word."""
        out = np.zeros(len(self.begin), np.uint64)
        for at, key, _, whole in self.spelled():
            out[at[whole]] = key[whole]
        return out

    def some(self, rows: np.ndarray) -> Words:
        return Words(self.codes, self.begin[rows], self.end[rows], self.text[rows], self.texts)


def words(array: pa.Array):
    """``Words`` of runs of texts."""
    _, offsets = byte_buffers(array)
    for a, b in pieces(np.diff(offsets), SLICE):
        texts = [(x or "").lower() for x in array.slice(a, b - a).to_pylist()]
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(x) + 1 for x in texts], np.int64)
        letter = letters()[codes]
        alone = np.zeros(len(codes), bool)
        for low, high in SCRIPTS:
            alone |= (codes >= low) & (codes <= high)
        alone &= letter
        before = np.append(False, letter[:-1]), np.append(False, alone[:-1])
        begin = np.flatnonzero(letter & (~before[0] | alone | before[1]))
        stops = np.flatnonzero(~letter)
        stop = stops[np.searchsorted(stops, begin)]
        end = np.where(alone[begin], np.minimum(begin + UNSPACED, stop), np.minimum(np.append(begin[1:], len(codes)), stop))
        parts = -(-(end - begin) // RUN)
        if (parts > 1).any():
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            end = np.minimum(np.repeat(begin, parts) + (nth + 1) * RUN, np.repeat(end, parts))
            begin = np.repeat(begin, parts) + nth * RUN
        yield Words(codes, begin, end, np.searchsorted(np.cumsum(size), begin, side="right"), len(texts))


def counts(array: pa.Array, toxic: np.ndarray) -> list[np.ndarray]:
    """(key, key before, toxic and ordinary occurrences, documents) of every letter in its context, in labelled texts."""
    found, at = [], 0
    for w in words(array):
        key = w.keys()
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        both = np.bincount(place, minlength=len(distinct))
        bad = np.bincount(place, weights=toxic[at + w.text], minlength=len(distinct)).astype(np.int64)
        order = np.lexsort((place, w.text))
        p, t = place[order], w.text[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
        docs = np.bincount(p[new], minlength=len(distinct))
        for rows, key, before, _ in w.some(first).spelled():
            found.append((key, before, bad[rows], (both - bad)[rows], docs[rows]))
        at += w.texts
    if not found:
        return [np.zeros(0, np.int64)] * 5
    key, before, bad, good, docs = (np.concatenate(x) for x in zip(*found, strict=True))
    distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
    total = lambda n: np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
    return [distinct.view(np.int64), before[first].view(np.int64), total(bad), total(good), total(docs)]


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(key, cond, back) of every letter of toxic texts whose context both classes know, and of the root.

    ``cond`` is the log ratio, toxic to ordinary, of the letter's probabilities in its context; ``back`` that of any
    letter that toxic texts don't have in the context that the letter leads to, null if not both classes know it.
    """
    ones = lambda c, n: F.count_if(F.col(c) == n).cast("double")
    r = counted.agg(*[ones(c, n).alias(f"{c}{n}") for c in ("toxic", "ordinary") for n in (1, 2)]).first()
    held = lambda c: F.lit(float(min(max(r[f"{c}1"] / max(r[f"{c}1"] + 2 * r[f"{c}2"], 1), 0.1), 0.95)))
    n, m, d, zero = held("toxic"), held("ordinary"), F.col("docs"), F.lit(0.0)
    new = F.col("toxic") == 0
    contexts = counted.groupBy(F.col("before").alias("context")).agg(
        F.sum("toxic").alias("bad"), F.sum("ordinary").alias("good"), (F.sum(d) + 1).alias("both"),
        F.sum(F.least("toxic", n)).alias("held_bad"), F.sum(F.least("ordinary", m)).alias("held_good"),
        F.sum(F.when(new, F.greatest(F.col("ordinary") - m, zero)).otherwise(zero)).alias("new_good"), (F.sum(F.when(new, d).otherwise(F.lit(0))) + 1).alias("new_docs"),
    )
    contexts = materialize(contexts.filter("bad > 0 and good > 0"), "contexts")
    share = lambda c: F.col(c) / F.col("both")
    p = (F.greatest(F.col("toxic") - n, zero) + F.col("held_bad") * share("docs")) / F.col("bad")
    q = (F.greatest(F.col("ordinary") - m, zero) + F.col("held_good") * share("docs")) / F.col("good")
    new_p = F.col("held_bad") * share("new_docs") / F.col("bad")
    new_q = (F.col("new_good") + F.col("held_good") * share("new_docs")) / F.col("good")
    back = contexts.select(F.col("context").alias("key"), (F.ln(new_p) - F.ln(new_q)).cast("float").alias("back"))
    known = counted.filter("toxic > 0").join(contexts, F.col("before") == F.col("context")).select("key", (F.ln(p) - F.ln(q)).cast("float").alias("cond"))
    root = back.filter(F.col("key") == signed(ROOT)).select("key", F.lit(0.0).cast("float").alias("cond"))
    return known.unionByName(root).join(back, "key", "left")


def signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


class Model:
    """``kneser_ney`` in memory: sorted keys."""

    def __init__(self, keys: np.ndarray, cond: np.ndarray, back: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.cond, self.back = keys[order], cond[order].astype(np.float32), back[order].astype(np.float32)
        self.met, self.known = np.zeros(0, np.uint64), np.zeros(0)  # keys of words that this worker has met, sorted, and their evidence

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def ratios(self, w: Words) -> np.ndarray:
        """Log ratio of each word's probabilities in both classes, along the letters that both know in context."""
        out = np.zeros(len(w.begin))
        root = self.find(np.array([ROOT], np.uint64))[0]
        if root < 0:
            return out
        i, at, before = 0, np.arange(len(out)), np.full(len(out), ROOT, np.uint64)
        back = np.full(len(out), self.back[root])
        while len(at):
            key, whole = w.letter(i, at, before)
            place = self.find(key)
            out[at] += np.where(place >= 0, self.cond[place], back)
            on = (place >= 0) & ~whole & ~np.isnan(self.back[place])
            i, at, before, back = i + 1, at[on], key[on], self.back[place[on]]
        return out

    def _of_words(self, w: Words, distinct: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Evidence of different words (sorted keys, and where in ``w`` each is), those met before from memory."""
        at = np.minimum(np.searchsorted(self.met, distinct), max(len(self.met) - 1, 0))
        hit = self.met[at] == distinct if len(self.met) else np.zeros(len(distinct), bool)
        out = np.zeros(len(distinct))
        out[hit] = self.known[at[hit]]
        new = np.flatnonzero(~hit)
        out[new] = evidence(self.ratios(w.some(first[new])))
        if len(self.met) + len(new) > MOST_MET:
            self.met, self.known = self.met[:0], self.known[:0]
        if len(new) <= MOST_MET:
            place = np.searchsorted(self.met, distinct[new])
            self.met, self.known = np.insert(self.met, place, distinct[new]), np.insert(self.known, place, out[new])
        return out

    def evidence(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the words' evidence, words) of each text."""
        sums, sizes = [], []
        for w in words(array):
            distinct, first, place = np.unique(w.keys(), return_index=True, return_inverse=True)
            sums.append(np.bincount(w.text, weights=self._of_words(w, distinct, first)[place], minlength=w.texts))
            sizes.append(np.bincount(w.text, minlength=w.texts))
        return np.concatenate(sums or [np.zeros(0)]), np.concatenate(sizes or [np.zeros(0, np.int64)])


def evidence(ratio):
    """Log-likelihood of a word in a toxic document less that in an ordinary one, from the models' log ratio."""
    return np.log1p(INSULTS * np.expm1(np.minimum(ratio, 50.0)))


def features(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One, the evidence by word, and by square root of the words."""
    n = np.maximum(sizes, 1)
    return np.stack([np.ones(len(n)), 10 * sums / n, sums / np.sqrt(n)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 80) -> tuple[float, ...]:
    """Newton's method with a small ridge; the rarer class weighs more, by the square root of the odds."""
    if not len(y) or y.min() == y.max():
        return (-2.0, 1.0, 1.0)  # nothing to fit on: the evidence as it is
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    ridge = np.diag([0.0] + [0.2] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


@dataclass
class Trained:
    table: DataFrame  # ``kneser_ney``
    letters: int  # its rows
    weights: tuple[float, ...]


def train(docs: DataFrame, labels: DataFrame, most_shipped: int = MOST_SHIPPED) -> Trained:
    """Counts over all labelled rows that may be learned from, but those of a fifth, ``MOST_FITTED`` at most, on which the score is fitted.

    ``labels`` has doc_id and toxic (null: no label); the larger holds if a document is labelled twice.
    """
    labels = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("long").alias("__toxic"))
    if labels.count() <= MOST_LABELS:
        labels = F.broadcast(labels)
    crc = crc_of_id()
    rows = docs.filter(crc % 3 != 1).select(F.col("doc_id").alias("__id"), "text", F.floor(crc / 3).alias("__r")).join(labels, "__id")
    n = rows.filter("__r % 5 = 0").count()
    fitting = (F.col("__r") % 5 == 0) & drawn(F.xxhash64("__id"), MOST_FITTED, n)

    def count(batches):
        forget()
        for batch in batches:
            made = counts(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "before", "toxic", "ordinary", "docs"])
        release_memory()

    small_batches(docs)
    counted = rows.filter(~fitting).select("text", "__toxic").mapInArrow(count, "key long, before long, toxic long, ordinary long, docs long")
    counted = counted.groupBy("key").agg(F.min("before").alias("before"), *[F.sum(c).alias(c) for c in ("toxic", "ordinary", "docs")])
    table = materialize(kneser_ney(materialize(counted, "letters")), "kneser-ney")
    trained = Trained(table, table.count(), (0.0, 0.0, 0.0))
    fitted = with_scores(rows.filter(fitting), trained, ["__toxic"], most_shipped).toPandas()
    x = features(fitted["__sum"].to_numpy(float), fitted["__n"].to_numpy(np.int64))
    trained.weights = fit_logistic(x, (fitted["__toxic"].to_numpy() > 0).astype(float))
    return trained


def with_scores(rows: DataFrame, trained: Trained, keep: list[str], most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """``keep`` columns with ``__sum``, ``__n`` and ``__score`` of each text; no shuffle unless the model is larger than ``most_shipped``."""
    made = _shipped(rows, trained, keep) if trained.letters <= most_shipped else _joined(rows, trained, keep)
    n = F.greatest(F.col("__n"), F.lit(1))
    a, b, c = (F.lit(w) for w in trained.weights)
    z = a + b * (F.lit(10.0) * F.col("__sum") / n) + c * (F.col("__sum") / F.sqrt(n))
    return made.withColumn("__score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0)))))


def _shipped(rows: DataFrame, trained: Trained, keep: list[str]) -> DataFrame:
    """The model goes to every worker."""

    def packed(batches):
        for batch in batches:
            key, cond, back = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            blobs = [key.astype(np.int64).tobytes(), cond.astype(np.float32).tobytes(), back.astype(np.float32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["key", "cond", "back"])

    blobs = trained.table.mapInArrow(packed, "key binary, cond binary, back binary").collect()  # 16 bytes a row
    joined = lambda c, t: np.frombuffer(b"".join([r[c] for r in blobs]), t)
    model = Model(joined("key", np.uint64), joined("cond", np.float32), joined("back", np.float32))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # MOST_SHIPPED rows at most

    def of(texts: pa.Array) -> list[pa.Array]:
        sums, sizes = shared.value.evidence(texts)
        return [pa.array(sums), pa.array(sizes.astype(np.int64))]

    return map_texts(rows, "text", keep, of, "__sum double, __n long")


def _joined(rows: DataFrame, trained: Trained, keep: list[str]) -> DataFrame:
    """The words go to the model: each different word meets the letters of the table once, then the texts that hold it."""
    base = materialize(rows.select(*keep, F.col("text").alias("__text"), F.monotonically_increasing_id().alias("__row")), "texts")
    small_batches(rows)

    def spell(batches):
        for batch in batches:
            at = 0
            for w in words(batch.column(1)):
                key = w.keys()
                _, first, place = np.unique(key, return_index=True, return_inverse=True)
                _, pair, n = np.unique(w.text.astype(np.int64) * len(first) + place, return_index=True, return_counts=True)
                chain: list[list[int]] = [[signed(ROOT)] for _ in range(len(first))]
                for rows_, made, _, _ in w.some(first).spelled():
                    for r, k in zip(rows_.tolist(), made.view(np.int64).tolist(), strict=True):
                        chain[r].append(k)
                lists = pa.array([chain[p] for p in place[pair].tolist()], pa.list_(pa.int64()))
                row = batch.column(0).take(pa.array(at + w.text[pair]))
                yield pa.RecordBatch.from_arrays([row, pa.array(key[pair].view(np.int64)), pa.array(n), lists], names=["__row", "word", "n", "chain"])
                at += w.texts

    held = materialize(base.select("__row", "__text").mapInArrow(spell, "__row long, word long, n long, chain array<long>"), "words")
    chains = held.groupBy("word").agg(F.first("chain").alias("chain"))
    steps = chains.select("word", F.size("chain").alias("size"), F.posexplode("chain").alias("at", "key")).join(trained.table, "key")
    known = steps.groupBy("word").agg(F.sum(F.col("cond").cast("double")).alias("r"), F.max(F.struct("at", "back")).alias("last"), F.first("size").alias("size"))
    missing = F.when(F.col("last.at") < F.col("size") - 1, F.coalesce(F.col("last.back").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    value = F.log1p(F.lit(INSULTS) * F.expm1(F.least(F.col("r") + missing, F.lit(50.0))))
    sums = held.select("__row", "word", "n").join(known.select("word", value.alias("v")), "word", "left")
    sums = sums.groupBy("__row").agg(F.sum(F.col("n") * F.coalesce("v", F.lit(0.0))).alias("__sum"), F.sum("n").alias("__n"))
    out = base.drop("__text").join(sums, "__row", "left")
    return out.select(*keep, F.coalesce("__sum", F.lit(0.0)).alias("__sum"), F.coalesce("__n", F.lit(0)).cast("long").alias("__n"))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = 0.7, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """``keep`` columns with ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Learns from ``doc_id``, ``text`` and the labels alone. Null and empty texts score as a text without any
    evidence. Without labels of both classes, or an empty table, scores follow a fixed function. Rows keep their
    number, repeated ones score alike; texts of any length are read whole. Other columns of any name don't
    matter, but names that begin with two underscores are reserved; ``keep`` can't hold the new columns' names.
    """
    trained = train(docs, labels, most_shipped)
    rows = docs.withColumn("__held", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)))
    out = with_scores(rows, trained, [*keep, "__held"], most_shipped)
    score = F.col("__score")
    return out.select(*keep, F.col("__held").alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, by ``labels.toxic``."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])

"""Language identification with bit-sliced Bloom filters of character n-grams.

Place p of the filter holds one word per 64 languages; bit l of it is place p of language l's own Bloom
filter. A look-up takes the AND of the words at an n-gram's places, so it says at once which languages
contain the n-gram. A text's n-grams are counted by language from those bits, the counts are
corrected for each filter's false positives, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_buffers, crc_of_id, forget, letters, map_texts, materialize, pieces, read, small_batches

GRAM = 4  # letters and blanks of an n-gram
LEAST, MOST = 1 << 16, 1 << 23  # places of the filter: a power of two, ``ROOM`` times the n-grams of the largest language's probes
ROOM = 4
PROBES = 3
DOCS_BY_LANGUAGE = 2000  # about so many documents of each language are learned from
SHARE = 0.2  # an n-gram is a language's if it has that part of its frequency over all languages
MUCH = 100_000  # n-grams of a language's texts from which one that comes once doesn't count
SLICE = 1 << 19  # bytes handled at once
UNKNOWN = "und"

def grams(array: pa.Array):
    """(packed n-grams, text of each, texts) for runs of texts.

    Lower-case letters; all between two words is one blank, with two blanks around a text, so that the
    shortest word has n-grams.
    """
    _, offsets = byte_buffers(array)
    for a, b in pieces(np.diff(offsets), SLICE):
        texts = [(x or "").lower() for x in array.slice(a, b - a).to_pylist()]
        codes = np.frombuffer("".join([f"  {x}  " for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), np.array([len(x) + 4 for x in texts], np.int64))
        letter = letters()[codes]
        codes = (codes & 0xFFFF) ^ (codes >> 16) * np.uint32(0x1F35)  # 16 bits of a letter, those of higher planes mixed in
        codes = np.where(letter, np.where(codes == 0x20, 0x21, codes & 0xFFFF), 0x20).astype(np.uint64)
        size = np.bincount(text, minlength=len(texts))
        edge = np.cumsum(size) - size
        keep = letter | np.append(True, letter[:-1])
        keep[edge] = keep[edge + 1] = True  # the two blanks before a text
        keep[edge + size - 1] = keep[edge + size - 2] = True
        codes, text = codes[keep], text[keep]
        n = max(len(codes) - GRAM + 1, 0)
        packed = np.zeros(n, np.uint64)
        for i in range(GRAM):
            packed = (packed << np.uint64(16)) | codes[i : i + n]
        own = text[:n] == text[GRAM - 1 :]
        blanks = sum(0x20 << (16 * i) for i in range(GRAM))
        own &= packed != np.uint64(blanks)
        yield packed[own], text[:n][own], len(texts)


def places(packed: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each n-gram among ``n``, by double hashing."""
    h = (packed ^ (packed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) & np.uint64(n - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filters:
    names: list[str]  # sorted; the languages by bit
    words: np.ndarray  # places x words of 64 languages
    false: np.ndarray  # chance of a false positive by language
    prior: int  # language of a text whose n-grams no language has

    def lookup(self, packed: np.ndarray) -> np.ndarray:
        """Bits of the languages that contain each n-gram."""
        found = None
        for p in places(packed, len(self.words)):
            found = self.words[p] if found is None else found & self.words[p]
        return found

    def counts(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts by text and language, n-grams by text)."""
        hits, totals = [], []
        for packed, text, n in grams(array):
            bits = self.lookup(packed)
            total = np.bincount(text, minlength=n)
            mine = np.zeros((n, len(self.names)))
            for i in range(len(self.names)):
                mine[:, i] = np.bincount(text, weights=(bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
            hits.append(np.maximum(mine - total[:, None] * self.false, 0) / (1 - self.false))
            totals.append(total)
        return np.concatenate(hits or [np.zeros((0, len(self.names)))]), np.concatenate(totals or [np.zeros(0, np.int64)])

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is the winner's part of all languages' counts."""
        if not self.names:
            return [UNKNOWN] * len(array), np.zeros(len(array))
        hits, totals = self.counts(array)
        best = hits.argmax(axis=1)
        top = hits.max(axis=1)
        best = np.where(top > 0, best, self.prior)
        score = np.where(top > 0, top / np.maximum(hits.sum(axis=1), 1e-9), 0.0)
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best.tolist(), totals.tolist(), strict=True)]
        return names, np.where(totals > 0, score, 0.0)


def build(names: list[str], language: np.ndarray, packed: np.ndarray, total: np.ndarray) -> Filters:
    """Filters of the n-grams chosen for each language, from (language number, n-gram) and the n-grams learned from by language."""
    most = int(np.bincount(language, minlength=1).max()) * PROBES * ROOM
    n = min(MOST, max(LEAST, 1 << max(most - 1, 1).bit_length()))
    words = np.zeros((n, max(1, -(-len(names) // 64))), np.uint64)
    false = np.zeros(len(names))
    for i in range(len(names)):
        bit = np.uint64(1) << np.uint64(i % 64)
        for p in places(packed[language == i], n):
            words[np.unique(p), i // 64] |= bit
        false[i] = np.mean((words[:, i // 64] & bit) > 0) ** PROBES
    return Filters(names, words, np.minimum(false, 0.99), int(total.argmax()) if names else 0)


def chosen(counted: DataFrame) -> DataFrame:
    """(l, g) of the n-grams that are a language's own share, from (l, g, n); one that comes once is noise only in a language with much text."""
    total = counted.groupBy("l").agg(F.sum("n").alias("t"))
    rated = counted.join(F.broadcast(total), "l").withColumn("r", F.col("n") / F.col("t"))  # a row a language
    own = rated.groupBy("g").agg((F.sum("r") * SHARE).alias("least"))
    mine = rated.join(own, "g").filter(F.col("r") * (1 + 1e-9) >= F.col("least"))  # sums are rounded
    return mine.filter((F.col("n") >= 2) | (F.col("t") < MUCH)).select("l", "g")


def train(docs: DataFrame, by_language: int = DOCS_BY_LANGUAGE) -> Filters:
    """Filters from a bounded sample: about ``by_language`` documents of each language, drawn by a hash of doc_id.

    Rows without a language and held-out rows are never learned from. N-grams are counted on executors.
    """
    crc = crc_of_id()
    rows = docs.filter(F.col("lang").isNotNull() & (crc % 5 != 0)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return build([], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))
    number = {n: i for i, n in enumerate(names)}
    plan = docs.sparkSession.createDataFrame([(n, number[n], max(1, int(min(1.0, by_language / sizes[n]) * (1 << 53)))) for n in names], "lang string, _l int, _of long")
    some = rows.join(F.broadcast(plan), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < F.col("_of"))

    def count(batches):
        forget()
        for batch in batches:
            language = batch.column(0).to_numpy()
            at = 0
            for packed, text, n in grams(batch.column(1)):
                of = language[at + text]
                at += n
                for i in np.unique(of):
                    key, k = np.unique(packed[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), pa.array(k)], names=["l", "g", "n"])

    small_batches(docs)
    counted = some.select("_l", "text").mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "n-grams")
    total = np.zeros(len(names))
    for r in counted.groupBy("l").agg(F.sum("n").alias("t")).collect():
        total[r["l"]] = r["t"]
    table = chosen(counted).toArrow()  # n-grams of the bounded sample
    return build(names, table.column("l").to_numpy().astype(np.int64), table.column("g").to_numpy().view(np.uint64), total)


def predicted(docs: DataFrame, keep: list[str], filters: Filters | None = None) -> DataFrame:
    """``keep`` columns with ``__lang`` and ``__score``; see ``identify``."""
    filters = filters or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # MOST words at most for each 64 languages

    def of(texts: pa.Array) -> list[pa.Array]:
        names, score = shared.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(score)]

    return map_texts(docs, "text", keep, of, "__lang string, __score double")


def identify(docs: DataFrame, keep: list[str], filters: Filters | None = None) -> DataFrame:
    """``keep`` columns with ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs``.

    Reads the whole text and nothing else of a row, however long it is. Null texts and texts without a letter are ``und`` with
    score 0. A text with letters that no language's n-grams match gets the most learned-from language,
    score 0. Ties go to the first language by name. Without any labelled row all texts are ``und``. Repeated rows
    stay repeated and are read alike; an empty table gives an empty result. Other columns of any name don't matter,
    but names that begin with two underscores are reserved; ``keep`` can't hold the new columns' names.
    """
    rows = docs.withColumn("__held", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)))
    out = predicted(rows, [*keep, "__held"], filters or train(docs))
    return out.select(*keep, F.col("__held").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    return identify(read(spark, sf_dir, "documents"), ["doc_id"])

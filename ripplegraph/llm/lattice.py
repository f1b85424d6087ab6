"""Language-model scores from a subword lattice.

A text is a sequence of units, each drawn by its own score, and its probability is the sum over all sequences of units that
spell it. Units are strings of three sizes: the pieces of an existing tokenizer's vocabulary, which spell any word (its single bytes
are among them); words; and passages, runs of words that end where a word says so. Pieces stay as the file has them.
Their scores begin as the file's ranks under Zipf's law and are refined by expected counts over all different words of the training texts,
which are what an unseen word looks like. Words and passages have their discounted count there, and what the discount holds back
goes to their spelling by smaller units. Units never cross a word's or a passage's end, so the forward recursion, in log
space, runs over each word's bytes, and a passage's and a text's probability follow from sums over words.

No table that grows with the corpus is broadcast: ``HOT`` words at most are, and all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, forget, materialize, read, release_memory, small_batches

END = "\n"  # the end of a text as a word; no word holds white space
HOT = 500_000  # words at most that are frequent enough to be broadcast
STOPS, EVERY, LONGEST = b".!?", 4, 256  # a passage ends at every fourth kind of word that ends so, or after so many words
ROUNDS = 2  # of expected counts
LONG = 16  # bytes of the longest piece used
WIDE = 64  # bytes of a word from which it is spelled by itself
HELD = 500_000  # counts that a task holds before it passes them on
TOGETHER = 200_000  # words spelled at once
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TURN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def existing_units(name: str = "piece_bpe_32k.model", path=None) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces that lower-cased words can hold, a word's start written as a blank, and first probabilities."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=(path or public_tokenizers.path)(name))
    weight: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            unit = text.replace("▁", " ").encode()
            if len(unit) <= LONG and b" " not in unit[1:] and unit == unit.translate(LOWER):
                weight[unit] = max(weight.get(unit, 0.0), 1 / (10 - model.get_score(i)))
    p = np.array(list(weight.values()))
    return list(weight), p / p.sum()


class Lattice:
    """Units with their log probabilities, found by their bytes in a table for each length."""

    def __init__(self, units: list[bytes], p: np.ndarray):
        self.log = np.append(np.log(p), -np.inf)
        self.number = {u: i for i, u in enumerate(units)}
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        self.tables = {n: self._table([units[i] for i in numbers], np.array(numbers)) for n, numbers in sorted(by.items())}
        self.lengths = sorted(by)

    def _table(self, units: list[bytes], numbers: np.ndarray):
        n = len(units[0])
        codes = np.frombuffer(b"".join(units), np.uint8).reshape(-1, n)
        key = self._key(self._packed(codes), n, n)
        bits = max(4, (16 * len(units) - 1).bit_length())
        keys, ids, probes = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, -1, np.int32), 1
        for k, i, at in zip(key, numbers.tolist(), ((key * TURN) >> np.uint64(64 - bits)).tolist(), strict=True):
            first = at
            while ids[at] >= 0:
                at += 1
            keys[at], ids[at], probes = k, i, max(probes, at - first + 1)
        return keys, ids, probes, np.uint64(64 - bits)

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        """The last eight bytes up to each place."""
        out = np.zeros(codes.shape, np.uint64)
        for j in range(codes.shape[1]):
            out[:, j] = codes[:, j] if j == 0 else (out[:, j - 1] << np.uint64(8)) | codes[:, j]
        return out

    @staticmethod
    def _key(packed: np.ndarray, end: int, n: int) -> np.ndarray:
        """A key of the ``n`` bytes before ``end``: the bytes themselves up to eight, then mixed with those before."""
        low = packed[:, end - 1]
        if n < 8:
            return low & np.uint64((1 << 8 * n) - 1)
        return low if n == 8 else low ^ (packed[:, end - 9] & np.uint64((1 << 8 * (n - 8)) - 1)) * MIX

    def _arcs(self, packed: np.ndarray, end: int):
        """(length, words with such a unit before ``end``, the unit) by length."""
        for n, (keys, ids, probes, shift) in self.tables.items():
            if n > end:
                break
            key = self._key(packed, end, n)
            slot = ((key * TURN) >> shift).astype(np.int64)
            found = np.full(len(key), -1, np.int32)
            for t in range(probes):
                hit = (keys[slot + t] == key) & (ids[slot + t] >= 0)
                found[hit] = ids[slot + t][hit]
            rows = np.flatnonzero(found >= 0)
            if len(rows):
                yield n, rows, found[rows]

    def _same_length(self, codes: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
        rows, size = codes.shape
        packed = self._packed(codes)
        alpha = np.full((size + 1, rows), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for end in range(1, size + 1):
            for n, at, unit in self._arcs(packed, end):
                alpha[end, at] = np.logaddexp(alpha[end, at], alpha[end - n, at] + self.log[unit])
                if expected is not None:
                    arcs.append((end, n, at, unit))
        if expected is not None:
            beta = np.full((size + 1, rows), -np.inf)
            beta[size] = 0.0
            for end, n, at, unit in reversed(arcs):
                after = beta[end, at] + self.log[unit]
                np.add.at(expected, unit, np.exp(alpha[end - n, at] + after - alpha[size, at]))
                beta[end - n, at] = np.logaddexp(beta[end - n, at], after)
        return alpha[size]

    def _alone(self, word: bytes, expected: np.ndarray | None) -> float:
        alpha, arcs = [0.0], []
        for end in range(1, len(word) + 1):
            total = -math.inf
            for n in self.lengths:
                if n > end:
                    break
                if (unit := self.number.get(word[end - n : end])) is not None:
                    x = alpha[end - n] + self.log[unit]
                    total = max(total, x) + math.log1p(math.exp(-abs(total - x))) if total > -math.inf else x
                    if expected is not None:
                        arcs.append((end, n, unit))
            alpha.append(float(total))
        if expected is not None:
            beta = [-math.inf] * len(word) + [0.0]
            for end, n, unit in reversed(arcs):
                after, at = beta[end] + self.log[unit], end - n
                expected[unit] += math.exp(alpha[at] + after - alpha[-1])
                beta[at] = max(beta[at], after) + math.log1p(math.exp(-abs(beta[at] - after))) if beta[at] > -math.inf else after
        return alpha[-1]

    def spelled(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word over all its spellings; adds the units' expected counts to ``expected``."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if size > WIDE:
                out[at] = [self._alone(b" " + words[i], expected) for i in at.tolist()]
            else:
                codes = np.frombuffer(b"".join([b" " + words[i] for i in at.tolist()]), np.uint8)
                out[at] = self._same_length(codes.reshape(len(at), size), expected)
        return out


def refined(types: DataFrame, units: list[bytes], p: np.ndarray, rounds: int = ROUNDS) -> Lattice:
    """The lattice after ``rounds`` of expected counts over the words ``types``; a row a unit and task reaches the driver's sums."""
    lattice = Lattice(units, p)
    for _ in range(rounds):
        shared = types.sparkSession.sparkContext.broadcast(lattice)  # the vocabulary's size

        def expect(batches, shared=shared):
            total = np.zeros(len(shared.value.number))
            for table in gathered(batches, TOGETHER):
                shared.value.spelled([w.encode() for w in table["word"].to_pylist()], total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["u", "e"])

        e = np.full(len(units), 0.01)
        for r in types.mapInArrow(expect, "u int, e double").groupBy("u").agg(F.sum("e").alias("e")).collect():
            e[r["u"]] += r["e"]
        lattice = Lattice(units, e / e.sum())
    return lattice


def split(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode().translate(LOWER).split()


def passages(words: list[bytes]) -> list[tuple[int, int]]:
    """(begin, end) of each passage; the last also holds the end of the text, which may be all it holds."""
    runs, begin = [], 0
    for end in [*[i + 1 for i, w in enumerate(words) if w[-1] in STOPS and crc32(w) % EVERY == 0], len(words)]:
        while end - begin > LONGEST:
            runs.append((begin, begin + LONGEST))
            begin += LONGEST
        runs.append((begin, end))
        begin = end
    return runs


def passage_key(words: list[bytes], begin: int, end: int, last: bool) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words[begin:end]) + (b"\n" if last else b"")) - (1 << 63)


def counted(texts: DataFrame) -> DataFrame:
    """(word, h, n) of the words (h 0) and passages (word null) of a table of texts; stored."""

    def count(batches):
        forget()
        words, keys = Counter(), Counter()

        def passed():
            n = [*words.values(), *keys.values()]
            columns = [pa.array([*(w.decode() for w in words), *([None] * len(keys))], pa.string()), pa.array([0] * len(words) + [*keys], pa.int64()), pa.array(n, pa.int64())]
            words.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "h", "n"])

        for batch in batches:
            for text in batch.column(0):
                mine = split(text.as_py())
                words.update(mine)
                words[b"\n"] += 1
                runs = passages(mine)
                keys.update([passage_key(mine, a, b, i == len(runs) - 1) for i, (a, b) in enumerate(runs)])
                if len(words) + len(keys) > HELD:
                    yield passed()
        yield passed()
        release_memory()

    small_batches(texts)
    rows = texts.mapInArrow(count, "word string, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n"))
    return materialize(rows, "counts")


@dataclass
class Counts:
    """All that is known of the counts of one kind of unit."""

    total: int
    kinds: int
    held: float  # the discount

    @classmethod
    def of(cls, rows: DataFrame) -> Counts:
        ones = lambda k: F.count_if(F.col("n") == k)
        total, kinds, one, two = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), ones(1), ones(2)).first()
        return cls(total, kinds, min(max(one / max(one + 2 * two, 1), 0.1), 0.95))

    @property
    def rest(self) -> float:
        """What the discounts hold back for smaller units."""
        return self.held * self.kinds / self.total if self.total else 1.0


@dataclass
class Words:
    """Base-10 logs of words' probabilities, from their counts and their spelling."""

    counts: Counts
    lattice: Lattice

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.counts.total + 0.5 * (self.counts.kinds + 1)))

    def score(self, n: np.ndarray, words: list[bytes]) -> np.ndarray:
        end = 1 / (self.counts.kinds + 1)  # of the spelled part
        spelled = self.lattice.spelled(words) + np.log1p(-end) if self.counts.kinds else self.lattice.spelled(words) + np.log(0.5)
        at = [i for i, w in enumerate(words) if w == b"\n"]
        spelled[at] = np.log(end if self.counts.kinds else 0.5)
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(n - self.counts.held, 0) / max(self.counts.total, 1))
        return np.logaddexp(own, spelled + math.log(self.counts.rest)) / math.log(10)


HEAD = "rid long, doc long, last long, tokens long, known long, base double, score double"


def read_passages(rows: DataFrame, words: Words, hot: dict[str, int]) -> DataFrame:
    """(r, word, head) of texts given as (rid, doc, text): a row with sums over its hot words for each passage, and one for each other word.

    ``r`` is the passage's key combined with ``rid``, that of the row. A head's word is a line end and more, which no word is.
    """
    names, n = list(hot), np.array(list(hot.values()), np.float64)
    values = [np.append(x, 0.0) for x in (n > 0, words.base(n), words.score(n, [w.encode() for w in names]))]
    shared = rows.sparkSession.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(names)}, values))  # HOT words at most
    schema = T.StructType().add("r", "long").add("word", "string").add("head", T._parse_datatype_string(HEAD))
    heads = pa.struct([(f.name, pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in schema["head"].dataType])

    def read_(batches):
        forget()
        number, (known, base, score) = shared.value
        end = number[b"\n"]
        for batch in batches:
            r, other, head = [], [], []
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                mine = split(text.as_py())
                runs = passages(mine)
                keys = [rid ^ passage_key(mine, a, b, i == len(runs) - 1) for i, (a, b) in enumerate(runs)]
                at = np.fromiter((number.get(w, -1) for w in [*mine, b"\n"]), np.int64, len(mine) + 1)
                begin = np.array([a for a, _ in runs], np.int64)
                sums = [np.add.reduceat(x[at], begin).tolist() for x in (known, base, score)]
                size = np.diff(np.append(begin, len(at))).tolist()
                r += keys
                head += [(rid, doc, int(i == len(runs) - 1), k, int(s), x, y) for i, (k, s, x, y) in enumerate(zip(size, *sums, strict=True))]
                other += [f"\n{k & 255}" for k in keys]
                rare = np.flatnonzero(at < 0)
                r += [keys[i] for i in (np.searchsorted(begin, rare, side="right") - 1).tolist()]
                other += [mine[i].decode() for i in rare.tolist()]
                head += [None] * len(rare)
            columns = [None if x is None else dict(zip(heads.names, x, strict=True)) for x in head]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(other, pa.string()), pa.array(columns, heads)], names=["r", "word", "head"])
        release_memory()

    return rows.mapInArrow(read_, schema)


def gathered(batches, rows: int):
    """Arrow batches put together to tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def weighed(parts: DataFrame, words: Words) -> DataFrame:
    """(r, head, c, score) of the parts, where other words, which now have their count ``c`` or null, get their score."""
    shared = parts.sparkSession.sparkContext.broadcast(words)  # the vocabulary's size

    def weigh(batches):
        for table in gathered(batches, TOGETHER):
            coded = table["word"].chunk(0).dictionary_encode() if len(table) else pa.array([], pa.string()).dictionary_encode()
            place = coded.indices.to_numpy()
            kinds = coded.dictionary.to_pylist()
            c = pc.fill_null(table["c"], 0).to_numpy()
            of = np.zeros(len(kinds))
            of[place] = c
            own = np.array([w[0] != "\n" for w in kinds], bool)
            score = np.zeros(len(kinds))
            score[own] = shared.value.score(of[own], [w.encode() for w in kinds if w[0] != "\n"])
            mine = own[place]
            yield pa.RecordBatch.from_arrays([table["r"].chunk(0), table["head"].chunk(0), pa.array(c, mask=~mine), pa.array(score[place].astype(np.float32), mask=~mine)], names=["r", "head", "c", "score"])
        release_memory()

    return parts.select("r", "word", "head", "c").mapInArrow(weigh, f"r long, head struct<{HEAD.replace(' ', ':')}>, c long, score float".replace(",:", ", "))


def sum_of_logs(a: Column, b: Column) -> Column:
    """Base-10 log of the sum of two numbers given by their logs."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), F.least(a, b) - F.greatest(a, b)))


def lattice_scores(rows: DataFrame, key: str, text: str, learn: Column) -> DataFrame:
    """``key`` column of all ``rows`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Counts and scores come from the rows where ``learn`` is true, all of them and their whole texts. A null text is an
    empty one, which is its end alone. Rows with a null key are scored like any other. Repeated rows stay repeated and score alike. Words and texts of any length are
    read whole; those of over ``WIDE`` bytes are spelled one by one. Without a row to learn from, all mass is the
    vocabulary's; an empty table gives an empty result. Other columns of any name don't matter.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    table = counted(rows.filter(learn).select(whole.alias("text")))
    types = table.filter("word is not null").select("word", "n")
    runs = table.filter("word is null").select("h", "n")
    counts, passage = Counts.of(types), Counts.of(runs)
    words = Words(counts, refined(types.filter(F.col("word") != END).select("word"), *existing_units()))
    frequent = (F.col("n") * HOT >= counts.total) | (F.col("word") == END)
    hot = {END: 0} | {r["word"]: r["n"] for r in types.filter(frequent).collect()}

    sent = rows.select(F.xxhash64(F.col(key), whole).alias("rid"), F.col(key).cast("long").alias("doc"), whole.alias("__text"))
    joined = read_passages(sent, words, hot).join(types.filter(~frequent).select("word", F.col("n").alias("c")), "word", "left")
    parts = weighed(joined, words).repartition("r")  # no two rows of a passage are likely to meet before
    base = F.log10((F.col("c") + 0.5) / (counts.total + 0.5 * (counts.kinds + 1)))
    some = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = parts.groupBy("r").agg(
        *[F.first(f"head.{c}", ignorenulls=True).alias(c) for c in ("rid", "doc", "last")], F.count("head").alias("copies"), F.sum("head.tokens").alias("tokens"),
        (F.sum("head.known") + F.count_if(F.col("c") > 0)).alias("known"), (F.sum("head.base") + some(base)).alias("base"), (F.sum("head.score") + some(F.col("score").cast("double"))).alias("score"),
    )
    met = sums.withColumn("h", F.col("r").bitwiseXOR(F.col("rid"))).drop("r").join(runs.withColumnRenamed("n", "c"), "h", "left")
    own = F.log10((F.col("c") - passage.held) / max(passage.total, 1))
    spelled = F.col("score") / F.col("copies") + math.log10(passage.rest)
    score = F.when(F.col("c").isNull(), spelled).otherwise(sum_of_logs(own, spelled)) * F.col("copies")
    total = met.groupBy("rid", "doc").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base")], F.sum(score).alias("score"), F.sum(F.col("last") * F.col("copies")).alias("rows"))
    per = {c: F.col(c) / F.col("rows") for c in ("tokens", "known", "base", "score")}  # equal rows of the table score alike
    total = total.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return total.select(
        F.col("doc").alias(key), per["tokens"].cast("long").alias("n_tokens"), per["known"].cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        per["base"].alias("base_score"), per["score"].alias("score"),
    )


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; rows without a doc_id are scored, neither held out nor learned from."""
    rest = F.coalesce(crc_of_id() % 5, F.lit(-1))
    out = lattice_scores(read(spark, sf_dir, "documents"), "doc_id", "text", (rest != 1) & (rest >= 0))
    return out.select("doc_id", (rest == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

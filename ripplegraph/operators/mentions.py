"""Many fixed strings looked for in many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4_000_000  # strings of one pass over the texts: some 60 bytes each in a worker's memory
STEP = 1 << 18  # characters that are looked at together
ROWS = 1 << 18  # rows of a result batch
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that powers have an inverse modulo 2^64


def mentions(texts: DataFrame, words: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """(value, key) of every text (key, text) and every word (value, string) whose string the text contains.

    The strings become one table of hashes by length, which a task runs over each text once, whatever their number; more than
    ``MOST`` take a pass for each ``MOST``. The empty string is in every text but a null one.
    """
    spark = texts.sparkSession
    if isinstance(words, list):
        words = spark.createDataFrame(words, "value string, string string")
    words = words.filter("value is not null and string is not null").distinct()
    schema = f"value string, key {texts.schema['key'].dataType.simpleString()}"
    out = spark.createDataFrame([], schema)
    passes = -(-words.count() // MOST)
    for i in range(passes):  # the strings of a value are in one pass
        out = out.unionByName(_pass(texts, words.filter(F.pmod(F.xxhash64("value"), F.lit(passes)) == i).toArrow(), schema))
    once = texts.filter("text is not null").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return out if once else out.distinct()  # a pass gives each value once for a text


def whole_and_untagged(topics: DataFrame) -> DataFrame:
    """(value, string) of topics (value): the topic itself, and what stands before its tag."""
    return topics.select("value", F.explode(F.array("value", F.substring_index("value", ":", 1))).alias("string"))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(n, pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(SPREAD)
    return h ^ (h >> np.uint64(29))


def _spread(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64) + np.uint64(1))


def _table(length: int, strings: list[str], values: np.ndarray) -> tuple:
    """Strings of one length: a filter over the first bits of their hashes, the hashes in order, and the characters and value of each."""
    codes = _codes("".join(strings)).reshape(-1, length)
    hashes = np.zeros(len(strings), np.uint64)
    for i, power in enumerate(_powers(length)):
        hashes += _spread(codes[:, i]) * power
    hashes = _mixed(hashes)
    order = np.argsort(hashes)
    hashes = hashes[order]
    bits = min(max(len(strings) * 64, 64).bit_length(), 31)
    first = hashes >> np.uint64(64 - bits)
    known = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(known, (first >> np.uint64(3)).astype(np.int64), np.left_shift(1, (first & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    return length, bits, known, hashes, codes[order], values[order]


def _found(codes: np.ndarray, room: np.ndarray, table: tuple, sums: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the strings of one length; ``room`` is what is left of a text from each place on."""
    length, bits, known, hashes, strings, values = table
    n = len(codes) - length + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _mixed((sums[length:] - sums[:n]) * inverse[:n])
    first = h >> np.uint64(64 - bits)
    hit = (known[(first >> np.uint64(3)).astype(np.int64)] >> (first & np.uint64(7)).astype(np.uint8)) & 1
    at = np.flatnonzero((hit > 0) & (room[:n] >= length))
    low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
    many = high - low
    row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at, many)
    same = np.ones(len(at), bool)
    for i in range(length):
        same &= codes[at + i] == strings[row, i]
    return at[same], values[row[same]]


def _pass(texts: DataFrame, words: pa.Table, schema: str) -> DataFrame:
    names = words.column("value").combine_chunks().dictionary_encode()
    values, ids = names.dictionary, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    strings = words.column("string").to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    tables = []
    for length in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == length)
        tables.append(_table(length, [strings[i] for i in mine], ids[mine]))
    shared = texts.sparkSession.sparkContext.broadcast((values, np.unique(ids[sizes == 0]), tables))  # MOST strings at most

    def find(batches):
        values, always, tables = shared.value
        more = max((t[0] for t in tables), default=1) - 1
        powers, inverse = _powers(2 * STEP + more), _powers(2 * STEP + more, True)

        def look(pieces: list[tuple[int, str]]) -> list[np.ndarray]:
            codes = _codes("".join(p for _, p in pieces))
            size = np.array([len(p) for _, p in pieces])
            doc = np.repeat(np.array([d for d, _ in pieces]), size)
            room = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(codes) * powers[: len(codes)])])
            out = []
            for table in tables:
                at, value = _found(codes, room, table, sums, inverse)
                out.append(np.unique(doc[at] * len(values) + value))
            return out

        for batch in batches:
            keys, held, size = batch.column("key"), [], 0
            found = [(np.arange(batch.num_rows)[:, None] * len(values) + always).ravel()]
            for doc, text in enumerate(batch.column("text").to_pylist()):
                for i in range(0, len(text), STEP):
                    piece = text[i : i + STEP + more]
                    if size + len(piece) > 2 * STEP + more:
                        found += look(held)
                        held, size = [], 0
                    held.append((doc, piece))
                    size += len(piece)
            if held:
                found += look(held)
            pairs = np.unique(np.concatenate(found))
            for i in range(0, len(pairs), ROWS):
                doc, value = np.divmod(pairs[i : i + ROWS], len(values))
                yield pa.RecordBatch.from_arrays([values.take(pa.array(value)).cast(pa.string()), keys.take(pa.array(doc))], names=["value", "key"])

    return texts.select("key", "text").filter("text is not null").mapInArrow(find, schema)

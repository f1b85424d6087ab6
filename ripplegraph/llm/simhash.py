"""SimHash near-duplicates with Golay-code keys.

A fingerprint's 64 bits are three segments of 22, 21 and 21. Two fingerprints that differ in two bits at
most have a segment that is equal in both (pigeonhole), and the next segment differs in two bits at most.
That next segment, as a 23-bit word, is decoded by the perfect binary Golay code to the codewords near it:
to the one within three bits, and where that is three bits away, to the five at four bits as well. Words
within two bits of each other always share one (tested over all cosets). A key is a segment's place, its
bits, and such a codeword's index; fingerprints that share a key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, read
from .components import components

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1 of the (23, 12) Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRWISE = 32  # fingerprints of a key up to which they are compared two by two
TOGETHER = 50_000  # fingerprints of a key up to which one task links them


def shingle_hashes(text: bytes, shingle: int) -> tuple[bytes, np.ndarray]:
    """A text's words with one space between, and the XXH64 of its shingles, repeats included; a shorter text is one shingle, none without words."""
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D only
    if not words:
        return b"", np.zeros(0, np.uint64)
    whole = b" ".join(words)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) > shingle else [whole]
    return whole, np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """64 majority bits of the XXH64 of a text's word shingles; 0 if it has no words."""
    return majority(shingle_hashes(text, shingle)[1])


def fingerprints(rows: DataFrame, text: str, keep: list[str], shingle: int) -> DataFrame:
    """``keep`` columns with ``fp``, the fingerprint as a signed long; no shuffle. Null text has no words."""

    def of(texts: pa.Array) -> list[pa.Array]:
        made = [fingerprint(x or b"", shingle) for x in texts.to_pylist()]
        return [pa.array(np.array(made, np.uint64).view(np.int64))]

    return map_texts(rows.withColumn("__bytes", F.col(text).cast("binary")), "__bytes", keep, of, "fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GENERATOR << (bit - 11), 0)
    return left


@lru_cache
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of weight three or less, whether its weight is three, the five of weight four."""
    patterns = {n: np.array([sum(1 << i for i in c) for c in combinations(range(23), n)], np.int64) for n in range(5)}
    error = np.zeros(2048, np.int64)
    three = np.zeros(2048, bool)
    for n in range(4):
        s = syndromes(patterns[n])
        error[s] = patterns[n]
        three[s] = n == 3
    four = np.zeros((2048, 5), np.int64)
    s = syndromes(patterns[4])
    order = np.argsort(s, kind="stable")
    s = s[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    four[s, rank] = patterns[4][order]
    return error, three, four


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the one or six codeword indices of each 23-bit word."""
    error, three, four = decoder()
    s = syndromes(words)
    far = np.flatnonzero(three[s])
    own = (words ^ error[s]) >> 11
    more = (words[far, None] ^ four[s[far]]) >> 11
    return np.concatenate([np.arange(len(words)), np.repeat(far, 5)]), np.concatenate([own, more.ravel()])


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each fingerprint."""
    bits = fps.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = near_codewords(parts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def star_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within two bits of each other, through the words one bit away.

    Two fingerprints are within two bits if and only if some word is within one bit of both, so
    joining all that surround a word loses no link and makes none that isn't there.
    """
    fps = np.unique(fps)
    flips = np.append(np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))
    around = (fps.view(np.uint64)[:, None] ^ flips).ravel()
    owner = np.repeat(np.arange(len(fps)), 65)
    order = np.argsort(around, kind="stable")
    around, owner = around[order], owner[order]
    follow = around[1:] == around[:-1]
    a, b = owner[1:][follow], owner[:-1][follow]
    root = np.arange(len(fps))
    while True:  # smallest neighbour, then its smallest, until nothing changes
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(len(fps)))
    return fps[other], fps[root[other]]


def links_of(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` of ``nodes`` within two bits, each at least through others.

    Keys shared by few are compared two by two, in a join that keeps only what is near. Keys shared by many
    are linked along the words one bit away, in one task up to ``TOGETHER`` fingerprints, and above that
    by those words as keys of their own, which at most 65 fingerprints share.
    """

    def with_keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for a in range(0, len(fps), 4096):
                row, key = keys_of(fps[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[a : a + 4096][row])], names=["key", "fp"])

    keyed = materialize(nodes.select("fp").mapInArrow(with_keys, "key long, fp long"), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(shared, "key"), "shared")
    few = shared.filter(F.col("n") <= PAIRWISE).select("key", "fp")
    x, y = few.alias("x"), few.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2)
    links = x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    def stars(table: pa.Table) -> pa.Table:
        a, b = star_links(table.column("fp").to_numpy())
        return pa.table({"a": a, "b": b})

    many = shared.filter((F.col("n") > PAIRWISE) & (F.col("n") <= TOGETHER))
    links = links.unionByName(many.select("key", "fp").groupBy("key").applyInArrow(stars, "a long, b long"))
    if not shared.filter(F.col("n") > TOGETHER).isEmpty():
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        huge = shared.filter(F.col("n") > TOGETHER).select("fp").distinct()
        around = huge.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
        met = around.groupBy("word").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("b")).filter(F.size("fps") > 1)
        links = links.unionByName(met.select(F.explode("fps").alias("a"), "b").filter("a <> b"))
    return links.distinct()


def near_duplicates(rows: DataFrame, text: str, key: str, shingle: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every row.

    Fingerprints within two bits are linked; a component's id is its smallest key. Null and empty texts
    have the fingerprint 0, linked like any other. Equal fingerprints are one node however many rows
    share it. Null keys don't name a component unless all of its keys are null. Repeated rows stay repeated. A text of
    any length is one fingerprint; an empty table gives an empty result. Other columns of any name don't matter.
    """
    printed = materialize(fingerprints(rows, text, [key], shingle), "fingerprints")
    nodes = printed.groupBy("fp").agg(F.min(key).alias("_least"))
    groups = components(links_of(nodes))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return printed.join(named.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``, over three-word shingles."""
    out = near_duplicates(read(spark, sf_dir, "documents"), "text", "doc_id")
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")

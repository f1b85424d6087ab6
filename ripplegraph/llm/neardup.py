"""Near-duplicate rows: SimHash with Golay-code keys, carried on to a similarity of word shingles.

Texts whose fingerprints lie within two bits share a key of ``simhash``. That finds copies with a few edits only, for
two texts of Jaccard similarity 0.8 differ in ten bits of 64 on average; so a text's shingles give ``BANDS`` more keys of
``ROWS`` min-hashes each, and a pair of similarity 0.8 shares none of them with a chance of 0.00007. Whatever
the key, texts are linked only if the Jaccard similarity of their whole shingle sets is high enough. Texts of the
same words are one node. Sets hold 32 bits of each shingle's hash, so of a million shingles one in some
thousands may be taken for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, forget, map_texts, materialize, release_memory
from .components import components
from .simhash import keys_of, majority, shingle_hashes

SHINGLE, TENTHS = 5, 8  # words of a shingle; tenths of similarity from which texts are near
BANDS, ROWS = 24, 5
MEMBERS = 1000  # texts that are held against a centre in one group
SHINGLES = 1 << 20  # shingles, about, of the texts on either side of a group

_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The min-hash keys of a set of shingles."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[i : i + 512, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))]


def signed(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``node``, ``n`` and ``hashes`` (shingles) and ``keys``; no shuffle. Null text has no words."""

    def of(texts: pa.Array) -> list[pa.Array]:
        import xxhash

        nodes, sets, bands, fps = [], [], [], []
        for x in texts.to_pylist():
            whole, h = shingle_hashes(x or b"", SHINGLE)
            nodes.append(xxhash.xxh3_64_intdigest(whole))
            fps.append(majority(h))
            bands.append(band_keys(np.unique(h)))
            sets.append(np.unique(h.astype(np.uint32)))
        row, golay = keys_of(np.array(fps, np.uint64).view(np.int64))
        count = np.bincount(row, minlength=len(nodes))
        ends = np.concatenate([[0], np.cumsum(BANDS + count)]).astype(np.int32)
        keys = np.zeros(int(ends[-1]), np.int64)
        for i, b in enumerate(bands):
            keys[ends[i] : ends[i] + BANDS] = np.array(b, np.uint64).view(np.int64)
        order = np.argsort(row, kind="stable")
        keys[np.repeat(ends[:-1] + BANDS - (np.cumsum(count) - count), count) + np.arange(len(row))] = golay[order]
        return [
            pa.array(np.array(nodes, np.uint64).view(np.int64)),
            pa.array([len(x) for x in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
            pa.array([x.tobytes() for x in sets], pa.binary()),
        ]

    return map_texts(rows.withColumn("__bytes", F.col(text).cast("binary")), "__bytes", keep, of, "node long, n long, keys array<long>, hashes binary")


def prefixes(members: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, member) of the rarest shingles of each member, as many as two near members can't differ in altogether.

    Of two sets whose similarity is t or more, one holds a part t of the other at least; so if both are sorted by one order, they
    share a shingle among the first n - ceil(t n) + 1. Rarest first, texts of one template share none of those.
    """
    owner = np.repeat(np.arange(len(members)), size)
    _, kind, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    rank = rank[kind]
    order = np.lexsort((rank, owner))
    rank, owner = rank[order], owner[order]
    first = np.cumsum(size) - size
    some = np.arange(len(owner)) - first[owner] < (size - -(-TENTHS * size // 10) + 1)[owner]
    rank, owner = rank[some], owner[some]
    order = np.argsort(rank, kind="stable")
    return rank[order], owner[order]


def near_pairs(nodes: np.ndarray, roots: np.ndarray, asks: np.ndarray, sets: list[bytes]) -> tuple[list[int], list[int]]:
    """Links between texts that ask and near ones of another root, one for each text and root.

    A text that asks is compared with those that share one of its rarest shingles, have another root and are of a size near its own.
    """
    members = [np.frombuffer(s, np.uint32) for s in sets]
    size = np.array([len(m) for m in members])
    rank, owner = prefixes(members, size)
    by_owner = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[by_owner], np.arange(len(members) + 1))
    a, b = [], []
    for i in np.flatnonzero(asks).tolist():
        mine = rank[by_owner[ends[i] : ends[i + 1]]]
        first, last = np.searchsorted(rank, mine, side="left"), np.searchsorted(rank, mine, side="right")
        n = last - first
        at = np.unique(owner[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)])
        sized = np.minimum(size[at], size[i]) * 10 >= np.maximum(size[at], size[i]) * TENTHS
        at = at[sized & (roots[at] != roots[i]) & (nodes[at] != nodes[i])]
        if not len(at):
            continue
        both = in_common(members[i], [members[j] for j in at.tolist()])
        near = at[10 * both >= TENTHS * (size[i] + size[at] - both)]
        near = near[np.unique(roots[near], return_index=True)[1]]
        a.extend([int(nodes[i])] * len(near))
        b.extend(nodes[near].tolist())
    return a, b


def in_common(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Shingles that a sorted set has in common with each of some others, none of them empty."""
    values = np.concatenate(others)
    place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
    begin = np.cumsum([0, *(len(x) for x in others[:-1])])
    return np.add.reduceat((mine[place] == values).astype(np.int64), begin)


def near_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within the groups (gid, node, root, asks): a group is read in one piece, and holds a bounded number of texts."""
    links = "a long, b long"

    def links_of(batch: pa.Table) -> pa.RecordBatch:
        columns = [batch.column(c).to_numpy() for c in ("node", "root", "asks")]
        a, b = near_pairs(*columns, batch.column("hashes").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
            if held and held[-1].column(0)[0].as_py() != gid[0]:
                yield links_of(pa.Table.from_batches(held))
                held = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x:
                    yield links_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield links_of(pa.Table.from_batches(held))
        release_memory()

    whole = groups.join(sets, "node").select("gid", "node", "root", "asks", "hashes")
    return whole.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, links).distinct()


def near_rows(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``component`` of every row: rows of one component are linked, at least through others.

    First, each key's texts are held against its centre: the text whose keys are shared most, so that the
    original of many copies is asked rather than one of the copies. Then, wherever a key's texts aren't all in one
    component, those outside its largest component are held against all others of that key. So a large group of
    near copies doesn't cost the square of its size, and no pair is left out that could join anything. Large keys
    are dealt over several groups on either side. Null and empty texts have no words and are one node; repeated
    rows stay repeated; a text of any length is read whole; an empty table gives an empty result.
    """
    made = [materialize(signed(rows, text, keep), "signed")]
    printed = made[0]
    keep_table = lambda df, what: made.append(materialize(df, what)) or made[-1]
    row = F.xxhash64(*[F.col(c) for c in keep])  # one row of a node brings its set, so that copies don't meet in one task
    nodes = keep_table(printed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(row).alias("row")), "nodes")
    keyed = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keep_table(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "key"), "shared")
    reach = shared.groupBy("node").agg(F.sum("k").alias("reach"))
    sets = printed.select("node", row.alias("row"), "hashes").join(nodes.select("node", "row").join(reach.select("node"), "node"), ["node", "row"], "left_semi")
    sets = keep_table(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    best = shared.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node", "n")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("m"))
    sizes = F.least("n", "m") * 10 >= F.greatest("n", "m") * TENTHS
    pairs = keep_table(shared.join(best, "key").filter((F.col("node") != F.col("centre")) & sizes).select("centre", "node").distinct(), "pairs")
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    gid = F.xxhash64("centre", "part")
    members = pairs.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    asking = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    held = members.select(gid.alias("gid"), "node", F.lit(False).alias("asks")).unionByName(asking.select(gid.alias("gid"), F.col("centre").alias("node"), F.lit(True).alias("asks")))
    links = keep_table(near_links(held.withColumn("root", F.col("node")), sets), "near")
    groups = components(links)

    named = shared.join(groups, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    named = keep_table(named, "named")
    by_root = named.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    most = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("all"), F.max(F.struct("c", "root", "n"))["n"].alias("in_most")).filter("roots > 1")
    blocks = most.select("key", "most", F.ceil(F.col("all") / SHINGLES).alias("wide"), F.ceil((F.col("all") - F.col("in_most")) / SHINGLES).alias("deep"))
    open_ = named.join(blocks, "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    gid = F.xxhash64("key", "x", "y")
    member = open_.withColumn("x", F.pmod(F.xxhash64("node"), F.col("wide"))).withColumn("y", upto("deep"))
    asker = open_.filter("root <> most").withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deep"))).withColumn("x", upto("wide"))
    held = member.select(gid.alias("gid"), "node", "root", F.lit(False).alias("asks")).unionByName(asker.select(gid.alias("gid"), "node", "root", F.lit(True).alias("asks")))
    held = held.groupBy("gid", "node", "root").agg(F.bool_or("asks").alias("asks"))
    rest = near_links(held, sets)
    groups = components(links.unionByName(rest))
    out = materialize(printed.select(*keep, "node").join(groups, "node", "left").select(*keep, F.coalesce("root", "node").alias("component")), "near-rows")
    for table in [*made, groups]:
        drop(table)
    return out

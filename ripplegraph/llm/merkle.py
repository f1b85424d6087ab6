"""Merkle manifest of a dataset: digests of rows, of sources and of all, with a proof for every row.

A source's rows are nodes in order of their ids, and every 16 consecutive nodes become one, until one is left. Nodes are handled in
aligned blocks of 256, two levels at a time: a block's digests are a contiguous matrix of 64 bytes a row, which is
reshaped by the fanout and hashed row by row, and where a node's siblings are follows from its place alone. The blocks' own digests are the nodes of
the next step, so that no source, however large, meets in one task; what stands above a block travels to it as one row.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_buffers, crc_of_id, materialize, numbered, read

FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
HEX = 64  # bytes of a digest
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = ["lefts", "rights", "subroot", "root"]


def matrix(digests: list[str] | pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of 64 bytes."""
    data, _ = byte_buffers(pa.array(digests, pa.string()) if isinstance(digests, list) else pa.concat_arrays(digests.chunks))
    return data.reshape(-1, HEX)


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level: every ``FAN`` consecutive nodes become one, the last run may be shorter."""
    whole = len(nodes) // FAN
    runs = [*nodes[: whole * FAN].reshape(whole, FAN * HEX), *([nodes[whole * FAN :].reshape(-1)] if len(nodes) % FAN else [])]
    return matrix([sha256(r.tobytes()).hexdigest() for r in runs])


def levels(nodes: np.ndarray, whole: bool) -> list[np.ndarray]:
    """A block's levels from its nodes to its digest: until one is left if the block is all there is, else ``LEVELS``."""
    found = [nodes]
    while len(found[-1]) > 1 if whole else len(found) <= LEVELS:
        found.append(parents(found[-1]))
    return found


def siblings(found: list[np.ndarray], at: int) -> tuple[list[str], list[str]]:
    """Digests to the left and to the right of node ``at`` and of its ancestors within their runs, level by level."""
    lefts, rights = [], []
    for level in found[:-1]:
        first = at // FAN * FAN
        lefts.append(level[first:at].tobytes().decode())
        rights.append(level[at + 1 : first + FAN].tobytes().decode())
        at //= FAN
    return lefts, rights


def folded(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that follows from a node and the siblings on its way."""
    for left, right in zip(lefts, rights, strict=True):
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def block(place: str = "place") -> Column:
    return F.floor(F.col(place) / BLOCK).cast("long").alias("block")


def climbed(nodes: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Tables of (keys, place, node, n) from the nodes to one row a group; ``n`` is the group's size."""
    names = [*keys, "place", "node", "n"]
    schema = nodes.select(*names).schema

    def up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n, number = rows["n"][0].as_py(), rows["place"][0].as_py() // BLOCK
        top = levels(matrix(rows["node"]), n <= BLOCK)[-1]
        one = {k: rows[k][:1] for k in keys} | {"place": pa.array([number]), "node": pa.array([top.tobytes().decode()]), "n": pa.array([-(-n // BLOCK)])}
        return pa.table(one)

    tables = [nodes]
    while len(tables) == 1 or (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = tables[-1].select(*names, block()).groupBy(*keys, "block")
        tables.append(materialize(blocks.applyInArrow(up, schema), "nodes"))
    return tables


def lowered(tables: list[DataFrame], keys: list[str], above: DataFrame, level: int) -> DataFrame:
    """(keys, place, path) of the nodes of one level, from the paths ``above`` of the groups' last nodes."""
    paths = above.select(*keys, F.lit(0).cast("long").alias("place"), *PATH)
    schema, texts = paths.schema, pa.list_(pa.string())

    def down(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows, up = rows.sort_by("place"), path.to_pylist()[0]
        found = levels(matrix(rows["node"]), rows["n"][0].as_py() <= BLOCK)
        ways = [siblings(found, i) for i in range(len(rows))]
        columns = {k: rows[k] for k in [*keys, "place"]}
        columns |= {name: pa.array([[*way[i], *up[name]] for way in ways], texts) for i, name in enumerate(("lefts", "rights"))}
        return pa.table(columns | {k: pa.array([up[k]] * len(rows), pa.string()) for k in ("subroot", "root")})

    for table in tables[level:-1][::-1]:
        nodes = table.select(*keys, "place", "node", "n", block()).groupBy(*keys, "block")
        paths = paths.withColumnRenamed("place", "block").groupBy(*keys, "block")
        paths = materialize(nodes.cogroup(paths).applyInArrow(down, schema), "paths")
    return paths


def proven(leaves: DataFrame, keys: list[str], paths: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of the leaves with what their proofs give; ``paths`` are those of the leaves' blocks."""
    schema = leaves.select(*keep, F.col("node").alias("leaf")).schema
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")

    def prove(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows, up = rows.sort_by("place"), path.to_pylist()[0]
        found = levels(matrix(rows["node"]), rows["n"][0].as_py() <= BLOCK)
        proofs, roots = [], []
        above = [x + y for x, y in zip(up["lefts"], up["rights"], strict=True)]
        for i, digest in enumerate(rows["changed"].to_pylist()):
            lefts, rights = siblings(found, i)
            proofs.append(sha256("".join([*[x + y for x, y in zip(lefts, rights, strict=True)], *above]).encode()).hexdigest())
            roots.append(folded(folded(digest, lefts, rights), up["lefts"], up["rights"]))
        columns = {c: rows[c] for c in keep} | {"leaf": rows["node"]}
        columns |= {k: pa.array([up[k]] * len(rows), pa.string()) for k in ("subroot", "root")}
        return pa.table(columns | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    blocks = leaves.select(*keys, *keep, "place", "node", "changed", "n", block()).groupBy(*keys, "block")
    return blocks.cogroup(paths.withColumnRenamed("place", "block").groupBy(*keys, "block")).applyInArrow(prove, schema)


def field(value: Column) -> Column:
    """A value as it enters a digest: ``-`` if null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(rows: DataFrame, source: str, order: str, fields: list[str], tampered: dict[str, Column]) -> DataFrame:
    """``order`` column of all rows with ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    A leaf is the digest of ``fields``; ``tampered`` gives other values of some of them, from which the leaf for
    ``folded_root`` is made. Leaves of a source ascend by ``order``, nulls first, equal ones by leaf; a null source comes before all others.
    Null and empty values differ. Repeated rows are leaves of their own. Texts of any length are hashed where they are read, and only
    digests travel. An empty table gives an empty result. Other columns of any name don't matter.
    """
    keys = ["__null", "__source"]
    digest = lambda of: F.sha2(F.concat(*[field(of.get(c, F.col(c))) for c in fields]), 256)
    leaves = rows.select(
        F.col(source).isNull().alias("__null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.col(order).alias("__order"), digest({}).alias("node"), digest(tampered).alias("changed")
    )
    leaves = numbered(materialize(leaves, "leaves"), keys, [F.col("__order"), F.col("node"), F.col("changed")], "place")
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("n"))
    leaves = materialize(leaves.join(sizes, keys), "leaves")
    tables = climbed(leaves, keys)

    every, subroots = ["__all"], tables[-1].select(*keys, F.col("node").alias("subroot"))
    sources = numbered(subroots, [], [F.col("__null").desc(), F.col("__source")], "place")
    n = F.lit(sources.count()).cast("long")
    sources = materialize(sources.select(*keys, F.lit(0).alias("__all"), "place", F.col("subroot").alias("node"), n.alias("n")), "sources")
    up = climbed(sources, every)
    none = F.lit([]).cast("array<string>")
    path = lowered(up, every, up[-1].select("__all", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root")), 0)
    above = sources.drop("n").join(path.drop("subroot"), [*every, "place"]).select(*keys, "lefts", "rights", F.col("node").alias("subroot"), "root")
    out = proven(leaves, keys, lowered(tables, keys, above, 1), ["__order"])
    return out.select(F.col("__order").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, depth: int) -> str:
    """CTEs of a tree from ``{name}0`` (g, p, h): its levels, and ``{name}way`` (g, p of level 0, sides of each level, top)."""
    out = []
    for k in range(depth):
        size = f"(select g, count(*) n from {name}{k} group by g)"
        out.append(f"{name}s{k} as (select a.g, a.p, coalesce(string_agg(b.h, '' order by b.p) filter (b.p < a.p), '') l, coalesce(string_agg(b.h, '' order by b.p) filter (b.p > a.p), '') r, any_value(n) n from {name}{k} a join {name}{k} b on a.g = b.g and a.p // 16 = b.p // 16 join {size} z on z.g = a.g group by a.g, a.p)")
        out.append(f"{name}{k + 1} as (select g, p // 16 p, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by p)) end h from {name}{k} join {size} z using (g) group by g, p // 16)")
    joins = " ".join(f"join {name}s{k} x{k} on x{k}.g = a.g and x{k}.p = a.p // {16**k}" for k in range(depth))
    sides = ", ".join(f"x{k}.l l{k}, x{k}.r r{k}, x{k}.n n{k}" for k in range(depth))
    out.append(f"{name}way as (select a.g, a.p, {sides}, t.h top from {name}0 a {joins} join {name}{depth} t on t.g = a.g)")
    return ", ".join(out)


def _sql(depth: int = 6, over: int = 4) -> str:
    """The manifest of up to 16 ** ``depth`` leaves a source and 16 ** ``over`` sources."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in [*FIELDS[:-1], text]) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = "list_reduce(list_transform(range(strlen(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint)"
    proof = " || ".join(f"s.l{k} || s.r{k}" for k in range(depth)) + " || " + " || ".join(f"u.l{k} || u.r{k}" for k in range(over))
    folds = [f"f{i + 1} as (select * replace (case when {t}.n{k} = 1 then x else sha256({t}.l{k} || x || {t}.r{k}) end as x) from f{i})" for i, (t, k) in enumerate([("s", k) for k in range(depth)] + [("u", k) for k in range(over)])]
    return f"""with recursive steps(i, k, c) as (select range, 0, range::bigint from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where k < 8),
table_ as (select list(c order by i) tab from steps where k = 8),
crcs as (select *, xor({crc}, 4294967295::bigint) crc from documents, table_),
leaves as (select doc_id, source, {leaf("text")} h, case when crc % 5 = 0 then {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} else {leaf("text")} end c from crcs),
sources as (select source, row_number() over (order by source is not null, source) - 1 g from (select distinct source from leaves)),
placed as (select doc_id, h, c, g, row_number() over (partition by g order by doc_id nulls first, h, c) - 1 p from leaves join sources on leaves.source is not distinct from sources.source),
a0 as (select g, p, h from placed), {_tree_sql("a", depth)},
u0 as (select 0 g, g p, h from a{depth}), {_tree_sql("u", over)},
f0 as (select placed.doc_id, placed.h, placed.c x, s, u from placed join away s on s.g = placed.g and s.p = placed.p join uway u on u.p = placed.g),
{", ".join(folds)}
select doc_id, h leaf, s.top subroot, u.top root, sha256({proof}) proof_sha256, x folded_root, x = u.top verified from f{depth + over}"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all ``documents``; where 5 divides the crc32 of the decimal doc_id (never of a null one), the text's A-Z are lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(F.coalesce(crc_of_id() % 5 == 0, F.lit(False)), F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), "source", "doc_id", FIELDS, {"text": text})


OP12_SQL = _sql()

"""Importance resampling towards a target distribution of hashed word features.

A document's features become an array of buckets, which higher-order functions build and a single aggregate sums
over a literal array of gains; no document is taken apart for its score, and of its features only counts by bucket are
shuffled. The arrays are stored once, since they are needed twice, for the counts and for the score. Documents are drawn by their weight with Gumbel noise from a seeded hash of their id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, numbered, read

BUCKETS, RUN = 10_000, 3  # RUN: words of the longest feature
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def bucketed(words: Column) -> Column:
    """Bucket of every run of 1 to ``RUN`` consecutive words."""

    def runs(n: int) -> Column:
        heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(heads, lambda w, i: (F.crc32(F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))]).cast("binary")) % BUCKETS).cast("int"))

    return F.concat(*[runs(n) for n in range(1, RUN + 1)])


def features(rows: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns with ``__words``, their number, and ``__buckets``."""
    split = rows.select(*keep, words(F.col(text)).alias("__w"))
    return split.select(*[c for c in split.columns if c != "__w"], F.size("__w").alias("__words"), bucketed(F.col("__w")).alias("__buckets"))


def totals(featured: DataFrame) -> dict[int, int]:
    """Features by bucket over all rows: ``BUCKETS`` numbers at most."""
    each = featured.select(F.explode_outer("__buckets").alias("b"))  # explode would filter by the array before its words are there, and split the text for every word
    return {r["b"]: r["n"] for r in each.groupBy("b").agg(F.count("b").alias("n")).collect() if r["n"]}


def gains(have: dict[int, int], want: dict[int, int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed part in the target to that in the corpus."""
    s, t = float(sum(have.values())), float(sum(want.values()))
    return [math.floor(1000 * math.log((want.get(b, 0) + 1.0) * (s + BUCKETS) / ((have.get(b, 0) + 1.0) * (t + BUCKETS)))) for b in range(BUCKETS)]


def resample(docs: DataFrame, target: DataFrame, text: str, key: str, percent: int, least_words: int, seed: int) -> DataFrame:
    """``key`` column of all ``docs`` with ``n_features``, ``weight``, ``score`` and ``rank``; drawn rows alone have a rank.

    Of the N rows with ``least_words`` words or more, ``percent`` of 100 are drawn, rounded down. Null and empty texts have no features,
    weight 0. A null key hashes as an empty one and comes last among equal scores; rows that are equal in key and
    score take ranks in any order. Texts are read whole, whatever their length. Repeated rows count each. Without a target or a document the
    gains follow from the other's counts alone; an empty table gives an empty result. Other columns of any name don't matter.
    """
    featured = materialize(features(docs, text, [F.col(key).alias("__key")]), "buckets")
    gain = F.split(F.lit(",".join(map(str, gains(totals(featured), totals(features(target, text, [])))))), ",").cast("array<bigint>")
    zero = F.lit(0).cast("long")
    weight = F.aggregate("__buckets", zero, lambda total, b: total + F.element_at(gain, b + 1))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    scored = featured.select("__key", (F.col("__words") >= least_words).alias("__open"), F.size("__buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("__noise"))
    scored = materialize(scored.withColumn("score", F.col("weight") + F.col("__noise")), "scores")
    drop(featured)
    drawn = scored.filter("__open").count() * percent // 100
    ranked = numbered(scored, [], [F.col("__open").desc(), F.col("score").desc(), F.col("__key").asc_nulls_last()], "__place")
    rank = F.when(F.col("__place") < drawn, F.col("__place") + 1)
    return ranked.select(F.col("__key").alias(key), "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, of which 5 % are drawn towards the distribution of ``benchmark``."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "text", "doc_id", 5, 20, 42)


OP13_SQL = f"""with recursive steps(i, k, c) as (select range, 0, range::bigint from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where k < 8),
table_ as (select list(c order by i) tab from steps where k = 8),
texts as (select true doc, doc_id, row_number() over () r, text from documents union all select false, null, -row_number() over (), text from benchmark),
split as (select doc, doc_id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}'), lambda x: x <> '') w from texts),
runs as (select doc, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) f from split),
kinds as (select f, hex(encode(f)) x from (select distinct f from runs)),
crcs as (select f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % {BUCKETS} b from kinds, table_),
counts as (select r, b, doc, count(*) n from runs join crcs using (f) group by all),
have as (select b, sum(n)::double n from counts where doc group by b), want as (select b, sum(n)::double n from counts where not doc group by b),
gain as (select b, floor(1000 * ln((coalesce(w.n, 0) + 1) * ((select coalesce(sum(n), 0) from have) + {BUCKETS}) / ((h.n + 1) * ((select coalesce(sum(n), 0) from want) + {BUCKETS}))))::bigint g from have h left join want w using (b)),
weights as (select r, sum(n)::bigint n_features, sum(n * g)::bigint weight from counts join gain using (b) where doc group by r),
scored as (select doc_id, len(w) >= 20 open, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint score from split left join weights using (r) where doc),
ranked as (select *, row_number() over (order by open desc, score desc, doc_id nulls last) place, 5 * count_if(open) over () // 100 drawn from scored)
select doc_id, n_features::bigint n_features, weight, score, case when place <= drawn then place end rank from ranked"""

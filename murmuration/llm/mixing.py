"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources receive a whole number of blocks by highest quotients; a source's blocks are divided in
the same way among its shards; a shard then takes its quota from its own documents in a seeded
order, starting at a seeded block. Only (document, source, size) is shuffled, by (source, shard,
bucket), and buckets hold a bounded number of words, so a source with a third of all rows is
spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import WORD, besides, text_of
from murmuration.session import write_stage

WEIGHT_CYCLE = (5, 2, 1)


@dataclass(frozen=True)
class Mix:
    """``block_words``: words of a block. ``shard_words``: words for which a source gets one more
    shard, up to ``shards``. ``bucket_words``: words of a shard kept together in one task."""

    weights: tuple[int, ...] = WEIGHT_CYCLE
    max_repeats: int = 3
    block_words: int = 16
    shards: int = 32
    shard_words: int = 250_000
    bucket_words: int = 1_000_000
    seed: str = "mix-1"


def sizes(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_of(column), F.lit(WORD)).cast("long"))


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target): one row per source, so windows over it stay small.

    Weights follow the sources' order by code point, nulls last. Sources whose share would pass
    ``max_repeats`` times their size are capped in order of size by weight; what they leave is
    shared by weight among the others.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    per = per.withColumn("_n", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(cycle, ((F.col("_n") - 1) % len(mix.weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * mix.max_repeats)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    per = per.withColumn("_level", left / F.sum("_w").over(rest))
    per = per.withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    # Once a source is free, all behind it are, at the level of the first.
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(every)
    return per.select(
        "source", "source_size",
        F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap").cast("double"))).alias("target"),
    )


def apportion(parties: DataFrame, house: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Whole seats by Sainte-Lague within each ``house``; a house without weight gets none.

    Rounding weight / (total / seats) is the highest-quotient result for some number of seats
    close to the wanted one; the few missing seats go to the highest next quotients, and the few
    too many are taken from the lowest last ones. Ties go by ``order``.
    """
    home = Window.partitionBy(*house)
    total = F.sum(weight).over(home)
    part = F.when(total > 0, F.col(weight) * F.col(seats) / total).otherwise(F.lit(0.0))
    rounded = parties.withColumn("_a", F.floor(part + 0.5).cast("long"))
    rounded = rounded.withColumn("_miss", F.when(total > 0, F.col(seats) - F.sum("_a").over(home)).otherwise(F.lit(0)))
    few = F.sequence(F.lit(1).cast("long"), F.abs("_miss"))
    step = rounded.where("_miss <> 0").withColumn("_j", F.explode(few))
    quotient = F.when(F.col("_miss") > 0, F.col(weight) / (2 * (F.col("_a") + F.col("_j")) - 1)).otherwise(
        F.col(weight) / (2 * (F.col("_a") - F.col("_j")) + 1)
    )
    step = step.where("_miss > 0 OR _j <= _a").withColumn("_q", quotient)
    # Among equal quotients the first in order keeps its seat, so seats are taken from the last.
    first = F.row_number().over(home.orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in order], "_j"))
    last = F.row_number().over(home.orderBy(F.asc("_q"), *[F.col(c).desc_nulls_first() for c in order], "_j"))
    step = step.withColumn("_r", F.when(F.col("_miss") > 0, first).otherwise(last)).where("_r <= abs(_miss)")
    change = step.groupBy(*order).agg(F.sum(F.signum("_miss")).cast("long").alias("_d"))
    renamed = change.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], "_d")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order)]
    joined = rounded.join(renamed, on, "left").withColumn(out, F.col("_a") + F.coalesce("_d", F.lit(0)))
    return joined.select(*parties.columns, out)


def _hex(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), column: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, ``extra``...): words the mix takes.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own,
    the last. No document is taken more than ``max_repeats`` times. Rows repeated in full are
    separate documents; which of them a quota falls on makes no difference to the rows returned.
    Columns named ``size``, ``source_size``, ``target`` or ``taken`` in ``docs`` are not read.
    """
    extra = besides(extra, ("doc_id", "source", "size", "source_size", "target", "taken"))
    sized = write_stage(sizes(docs, column).select("doc_id", "source", "size", *extra), "sizes")
    wanted = targets(sized, mix)
    wanted = wanted.withColumn("_seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / mix.block_words + 0.5).cast("long"))
    wanted = wanted.withColumn("_house", F.lit(0))
    sources = write_stage(apportion(wanted, ["_house"], ["source"], "target", "_seats", "blocks"), "sources")

    # A document's seeded digest gives its shard, its bucket and its place in the bucket.
    named = sources.select(
        F.col("source").alias("_s"), "source_size", "target", "blocks",
        F.least(F.lit(mix.shards), F.ceil(F.col("source_size") / mix.shard_words)).cast("long").alias("_shards"),
    )
    digest = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_h", digest)
    rows = rows.withColumn("_shard", _hex(F.col("_h"), 1) % F.greatest("_shards", F.lit(1)))
    buckets = F.ceil(F.col("source_size") / F.greatest("_shards", F.lit(1)) / mix.bucket_words).cast("long")
    rows = rows.withColumn("_bucket", _hex(F.col("_h"), 9) % F.greatest(buckets, F.lit(1)))

    # Offsets: words of the shard's earlier buckets, then of the bucket's earlier documents.
    per_bucket = rows.groupBy("source", "_shard", "_bucket", "blocks").agg(F.sum("size").alias("_words"))
    in_shard = Window.partitionBy("source", "_shard")
    per_bucket = per_bucket.withColumns({
        "_before": F.coalesce(
            F.sum("_words").over(in_shard.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_shard_words": F.sum("_words").over(in_shard),
    })
    quota = apportion(
        per_bucket.where("_before = 0").groupBy("source", "_shard", "blocks").agg(F.max("_shard_words").alias("_total")),
        ["source"], ["source", "_shard"], "_total", "blocks", "quota",
    ).select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "quota")
    placed = per_bucket.join(
        quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left"
    ).select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), F.col("_bucket").alias("_b"), "_before", "_shard_words", "quota")
    rows = rows.join(
        placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")) & (F.col("_bucket") == F.col("_b"))
    )
    in_bucket = Window.partitionBy("source", "_shard", "_bucket").orderBy(
        "_h", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", _taken(mix).alias("taken"), *extra)


def _taken(mix: Mix) -> Column:
    """Words of a document inside its shard's quota.

    Full passes over the shard take the document whole; the blocks left over are consecutive
    ones of the seeded document order, from a seeded first block on and around the end.
    """
    block, total, quota = F.lit(mix.block_words), F.col("_shard_words"), F.coalesce(F.col("quota"), F.lit(0))
    blocks = F.greatest(F.ceil(total / block).cast("long"), F.lit(1))
    passes = F.floor(quota / blocks).cast("long")
    rest = quota - passes * blocks
    seeded = _hex(F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce("source", F.lit("")), F.col("_shard").cast("string")).cast("binary")), 1)
    first = seeded % blocks
    low, high = F.col("_from"), F.col("_from") + F.col("size")
    overlap = lambda a, b: F.greatest(F.least(high, b) - F.greatest(low, a), F.lit(0))
    a, b = first * block, (first + rest) * block
    partly = overlap(a, b) + overlap(F.lit(0), b - blocks * block)
    taken = F.least(passes, F.lit(mix.max_repeats)) * F.col("size") + F.when(passes < mix.max_repeats, partly).otherwise(F.lit(0))
    return taken.cast("long")


def mixture(docs: DataFrame, mix: Mix = Mix(), column: str = "text") -> DataFrame:
    """The mixed documents, whole: each repeated taken / size times, rounded half up.

    Columns are those of ``docs``. Documents the mix takes less than half of are left out.
    """
    sized = docs.withColumn("_mm_key", F.md5(text_of(column).cast("binary")))
    taken = mix_sources(sized, mix, column, ("_mm_key",))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    # Of rows alike in (doc_id, source, text) one stands for all, with the copies of all.
    plan = taken.where("size > 0").groupBy("doc_id", "source", "_mm_key").agg(
        F.sum(copies).alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_mm_key").alias("_k"), "_copies", "_rows").where("_copies > 0")
    joined = sized.join(
        plan, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_mm_key") == F.col("_k"))
    )
    several = joined.where("_rows > 1").dropDuplicates(["doc_id", "source", "_mm_key"])
    each = joined.where("_rows = 1").unionByName(several)
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


DIGEST = ("doc_id", "size", "source_size", "target", "taken")


def digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "source", "text")).select(*DIGEST)


_MIX = Mix()
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    md5('{_MIX.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(f"{w}.0" for w in _MIX.weights)}][(n - 1) % {len(_MIX.weights)} + 1] AS w,
    {_MIX.max_repeats} * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, n, CAST(source_size AS BIGINT) AS source_size,
    CAST(least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w) AS DOUBLE) AS target
  FROM l
), q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS r
  FROM (SELECT source, target, unnest(range(1, CAST(target / {_MIX.block_words} AS BIGINT) + 40)) AS k FROM t WHERE target > 0)
), b AS (
  SELECT t.*, least({_MIX.shards}, CAST(ceil(source_size / {_MIX.shard_words}) AS BIGINT)) AS shards,
    (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM t.source
      AND r <= (SELECT floor(sum(source_size) / {_MIX.block_words} + 0.5) FROM t)) AS blocks
  FROM t
), p AS (
  SELECT d.*, source_size, target, blocks, CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(shards, 1) AS shard,
    CAST('0x' || substr(h, 9, 8) AS BIGINT)
      % greatest(CAST(ceil(source_size / greatest(shards, 1) / {_MIX.bucket_words}) AS BIGINT), 1) AS bucket
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY bucket, h, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(size) OVER (PARTITION BY source, shard) AS total
  FROM p
), hs AS (
  SELECT source, shard, blocks, total, sum(total) OVER (PARTITION BY source) AS house
  FROM (SELECT DISTINCT source, shard, blocks, total FROM o)
), hq AS (
  SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY total / (2 * k - 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(1, CAST(total * blocks / house AS BIGINT) + 40)) AS k FROM hs WHERE house > 0)
), u AS (
  SELECT source, shard, count(*) AS quota FROM hq WHERE r <= blocks GROUP BY source, shard
), f AS (
  SELECT o.*, coalesce(quota, 0) AS quota, greatest(CAST(ceil(total / {_MIX.block_words}) AS BIGINT), 1) AS n,
    CAST('0x' || substr(md5('{_MIX.seed}:' || coalesce(o.source, '') || ':' || o.shard), 1, 8) AS BIGINT) AS seeded
  FROM o LEFT JOIN u ON u.source IS NOT DISTINCT FROM o.source AND u.shard = o.shard
), g AS (
  SELECT *, quota // n AS passes, (seeded % n) * {_MIX.block_words} AS x,
    (seeded % n + quota - (quota // n) * n) * {_MIX.block_words} AS y FROM f
)
SELECT doc_id, size, source_size, target, CAST(least(passes, {_MIX.max_repeats}) * size + CASE WHEN passes < {_MIX.max_repeats} THEN
    greatest(least(a + size, y) - greatest(a, x), 0) + greatest(least(a + size, y - n * {_MIX.block_words}) - a, 0)
  ELSE 0 END AS BIGINT) AS taken
FROM g
"""

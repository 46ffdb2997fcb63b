"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of raw text, give each
document the log ratio of its probabilities; Gumbel noise on top makes the k largest a sample
without replacement in proportion to the ratios. Counting, scoring and drawing are DataFrame
operations; what the models hold is one number per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import bound, text_of, words_of
from murmuration.session import write_stage


@dataclass(frozen=True)
class Resampling:
    """``buckets`` bounds the models; ``share`` is the part of the documents drawn, ``seed`` the
    noise; ``target_rows`` bounds the labelled documents the target model is fitted on."""

    buckets: int = 8192
    share: float = 0.25
    seed: int = 11
    target_rows: int = 20_000


def gram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of all words and of all neighbouring pairs of words."""
    def of(w):
        ones = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        twos = F.transform(
            F.sequence(F.lit(0), F.size(w) - 2),
            lambda i: F.pmod(F.xxhash64(w[i], w[i + 1]), F.lit(buckets)).cast("int"))
        return F.when(F.size(w) < 2, ones).otherwise(F.concat(ones, twos))

    return bound(words_of(F.lower(text)), of)


def _counts(grams: DataFrame, name: str) -> DataFrame:
    return grams.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def log_ratios(raw: DataFrame, target: DataFrame, buckets: int) -> Column:
    """Log probability ratio of every bucket as one array, a scalar subquery; add-one smoothing."""
    both = _counts(raw, "raw").join(_counts(target, "target"), "bucket", "full").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    # One row per bucket at most, so the array is bounded.
    one = both.agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("raw", "target").alias("n")))).alias("m"),
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    at = lambda b, f: F.coalesce(F.col("m")[b][f], F.lit(0)) + 1
    ratio = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.log(
        (at(b, "target") / (F.coalesce("target", F.lit(0)) + buckets)) / (at(b, "raw") / (F.coalesce("raw", F.lit(0)) + buckets))))
    return one.select(ratio.alias("r"))


def gumbel(key: Column, seed: int) -> Column:
    """Noise that depends on the key and the seed alone."""
    unit = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def with_rank(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` (from 1) in a total order, by range partitions and their sizes."""
    parts = df.repartitionByRange(*order).withColumn("_mm_part", F.spark_partition_id())
    parts = write_stage(parts, "ranges")
    sizes = parts.groupBy("_mm_part").agg(F.count(F.lit(1)).alias("_mm_rows"))
    # One row per partition.
    before = Window.orderBy("_mm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_mm_part", F.coalesce(F.sum("_mm_rows").over(before), F.lit(0)).alias("_mm_before"))
    placed = parts.join(F.broadcast(starts), "_mm_part")
    inside = F.row_number().over(Window.partitionBy("_mm_part").orderBy(*order))
    return placed.withColumn("rank", (F.col("_mm_before") + inside).cast("long")).drop("_mm_part", "_mm_before")


def resample(docs: DataFrame, target_ids: DataFrame, how: Resampling = Resampling(), column: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight, key, rank, selected) of every document.

    ``target_ids`` names the documents of the target by ``doc_id``; those of the smallest hashes,
    at most ``target_rows``, fit its model, while the raw model counts all documents. Null and
    empty texts have no n-grams and weight 0; their key is noise alone. Equal keys rank by doc_id,
    nulls first; repeated rows are ranked one after the other. Without target rows all ratios come
    from smoothing.
    """
    grams = docs.select("doc_id", gram_buckets(text_of(column), how.buckets).alias("grams"))
    ids = target_ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
    target = grams.join(F.broadcast(ids.limit(how.target_rows)), "doc_id", "left_semi")
    table = write_stage(log_ratios(grams, target, how.buckets), "ratios")
    weight = bound(F.col("_mm_ratios"), lambda r: F.aggregate("grams", F.lit(0.0), lambda a, g: a + r[g]))
    scored = grams.withColumn("_mm_ratios", table.scalar()).select(
        "doc_id", F.size("grams").cast("long").alias("n_grams"), weight.alias("log_weight"))
    scored = scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), how.seed))
    ranked = with_rank(write_stage(scored, "weights"), F.desc("key"), F.asc("doc_id"))
    return ranked.withColumn("selected", F.col("rank") <= F.ceil(F.lit(how.share) * docs.agg(F.count(F.lit(1))).scalar()))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"))

"""Dataset publication: partitioned copies by kind and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.scores import size_class
from murmuration.operators.ranking import numbered
from murmuration.sources import raw as R


def listed_subreddits(found: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """(position, subreddit): configured names in their order, then other found names sorted."""
    spark = found.sparkSession
    names = found.where(F.col("subreddit").isNotNull()).select(F.col("subreddit").cast("string")).distinct()
    fixed = spark.createDataFrame(
        [(i, str(name)) for i, name in enumerate(configured)], "position int, subreddit string"
    )
    extra = names.join(fixed.select("subreddit"), "subreddit", "left_anti")
    tail = numbered(extra, ["subreddit"], "position").select(
        (F.col("position") + len(configured)).cast("int").alias("position"), "subreddit")
    return fixed.unionByName(tail)


def publish_manifest(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(item, value): rows per kind, size class of the whole, and each skipped empty file."""
    files = R.kind_counts(spark, raw_dir)
    totals = files.groupBy("kind").agg(F.sum("rows").alias("rows"))
    kinds = spark.createDataFrame([(k,) for k in R.KINDS], "kind string")
    per_kind = kinds.join(totals, "kind", "left").select(
        F.col("kind").alias("item"), F.coalesce("rows", F.lit(0)).cast("string").alias("value")
    )
    size = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(
        F.lit("size").alias("item"), size_class(F.col("rows")).alias("value")
    )
    skipped = files.where("rows = 0").select(F.lit("skipped").alias("item"), F.col("file").alias("value"))
    return per_kind.unionByName(size).unionByName(skipped)


def stage_dataset(spark: SparkSession, raw_dir: str, out_dir: str) -> dict:
    """Write ``posts/`` and ``comments/`` folders; kinds without rows are left out.

    Only the manifest (one row per raw file kind and skipped file) comes back to the driver.
    """
    manifest = publish_manifest(spark, raw_dir).where("item <> 'size'").collect()
    counts = {row["item"]: int(row["value"]) for row in manifest if row["item"] in R.KINDS}
    if not any(counts.values()):
        raise FileNotFoundError(f"No non-empty raw parquet files in {raw_dir}.")
    for kind in R.KINDS:
        if counts[kind]:
            R.write_table(R.load_kind(spark, raw_dir, kind), f"{out_dir.rstrip('/')}/{kind}")
    return {"counts": counts, "skipped": sorted(r["value"] for r in manifest if r["item"] == "skipped")}

"""Streaming ingest of landed pages and daily counts over the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.sources.landing import flatten_pages
from murmuration.sources.raw import normalize_activity


def stream_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of page payloads, one landed JSON file per row."""
    return (
        spark.readStream.format("text").option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
        .withColumnRenamed("value", "payload")
    )


def stream_activity(pages: DataFrame, kind: str | None = None, late: str = "1 day") -> DataFrame:
    """Activity rows from a stream of pages, later copies of an id within ``late`` dropped.

    State holds one entry per id inside the watermark. Rows without id or time cannot be
    copies of anything in the state and pass by it.
    """
    rows = flatten_pages(pages)
    tagged = rows.withColumn("kind", F.lit(kind) if kind else F.when(F.col("body").isNotNull(), "comment").otherwise("post"))
    activity = normalize_activity(tagged)
    keyed = F.col("id").isNotNull() & F.col("created_dt").isNotNull()
    once = activity.where(keyed).withWatermark("created_dt", late).dropDuplicatesWithinWatermark(["id"])
    return once.unionByName(activity.where(~keyed))


def stream_daily(activity: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, rows) appended once the watermark has passed the day; gaps are filled when read."""
    return (
        activity.where(F.col("created_dt").isNotNull()).withWatermark("created_dt", late)
        .groupBy(F.window("created_dt", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.to_date("w.start").alias("day"), "rows")
    )


def run_available(stream: DataFrame, out: str, state: str):
    """Write everything that has landed so far to Parquet and stop; resumable by ``state``."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )

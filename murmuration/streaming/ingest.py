"""Pages on a stream, landed so that the result equals the batch load.

Three things make it so. The resume cursor is state per (kind, subreddit): the next page, the pages
taken, the latest second of the last page and whether the load has ended. Ids are told apart by an
index that never forgets, not by a watermark, so a copy weeks later is still a copy. And every micro
batch writes under its own number, so one that runs again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from murmuration.operators.daily import fill_days
from murmuration.session import discard, prepare, write_stage
from murmuration.sources.landing import flatten_keyed, keep_first, page_stats
from murmuration.sources.raw import add_day, normalize_activity, write_days

KEYS = ("kind", "subreddit")
# Parts of the id index; a batch looks into those its ids fall into.
BUCKETS = 64

_STATE = "next_page long, pages long, latest double, ended boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageCursor(StatefulProcessor):
    """Decides page by page what a resumable load takes; see ``usable_pages`` for the rules."""

    def __init__(self, limit: int, max_pages: int):
        self.limit, self.max_pages = limit, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, pages, latest, ended = self.at.get() if self.at.exists() else (None, 0, None, False)
        if ended:
            return
        # One micro batch of one key, at most the pages a trigger takes in.
        batch = pd.concat(list(rows)).sort_values("page", kind="stable")
        taken = []
        for i, (page, size, last) in enumerate(zip(batch["page"], batch["n_rows"], batch["latest"])):
            page, size, last = int(page), int(size), None if pd.isna(last) else float(last)
            if ended or expected is not None and page < expected or expected is None and size == 0:
                # Ended, seen before, or nothing found yet.
                continue
            if expected is not None and page > expected or size == 0 or pages >= self.max_pages:
                ended = True
                continue
            taken.append(i)
            pages += 1
            ended = last is None or last == latest or size < self.limit or pages >= self.max_pages
            expected, latest = page + 1, last
        if expected is not None:
            self.at.update((expected, pages, latest, ended))
        yield batch.iloc[taken].drop(columns=["n_rows", "latest"])

    def close(self) -> None:
        pass


def taken_pages(pages: DataFrame, limit: int, max_pages: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The pages of a stream of (keys, page, payload) that a resumable load takes.

    Pages of one key must land in order, in any split over micro batches; a page that lands again is
    passed over. A page after the end costs nothing but its own statistics.
    """
    size, latest = page_stats(F.col("payload"))
    order = [*keys, "page", "payload"]
    known = pages.select(*keys, F.col("page").cast("long").alias("page"), "payload").withColumns({"n_rows": size, "latest": latest})
    return known.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=PageCursor(limit, max_pages), outputStructType=known.select(*order).schema,
        outputMode="Append", timeMode="None").select(*order)


def _ids(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """(bucket, id) landed by batches before this one; null where nothing has landed yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ids")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    index = spark.read.schema("id string, batch long, bucket int").parquet(f"{out}/ids")
    return index.where(F.col("batch") < before).select("bucket", "id")


def land_batch(pages: DataFrame, batch: int, out: str, keys: tuple[str, ...] = KEYS) -> None:
    """Write the new rows of one micro batch: activity by (day, batch), their ids, and the days' counts.

    The first row of an id in landing order stays: by batch, then page, then place in the page. Rows without
    an id all stay. Counts of the days touched are taken anew from the activity, so late rows
    correct a day that was written before. Running a batch again replaces its own files only.
    """
    spark = prepare(pages.sparkSession)
    rows = keep_first(flatten_keyed(pages, keys), ["page", "pos", *keys])
    rows = write_stage(rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")), "landing")
    fresh, index = rows, _ids(spark, out, batch)
    if index is not None:
        # Only ids of this batch leave the index, so the anti join is against few rows.
        own = rows.where("id IS NOT NULL").select("bucket", "id")
        known = index.join(own, ["bucket", "id"], "left_semi").distinct()
        fresh = rows.join(known, ["bucket", "id"], "left_anti")
    activity = add_day(normalize_activity(fresh.drop("page", "pos"))).withColumn("batch", F.lit(batch))
    activity = write_stage(activity, "landing")
    write_days(activity.drop("bucket"), f"{out}/activity", "batch")
    ids = activity.where("id IS NOT NULL").select("id", "batch", "bucket")
    ids.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch", "bucket").parquet(f"{out}/ids")
    # One row per calendar day.
    days = [r["day"] for r in activity.where("day IS NOT NULL").select("day").distinct().collect()]
    if days:
        landed = spark.read.parquet(f"{out}/activity").where(F.col("day").isin(days))
        write_days(landed.groupBy("day").agg(F.count(F.lit(1)).alias("rows")), f"{out}/daily")
    discard(rows, activity)


def land_stream(pages: DataFrame, out: str, state: str, limit: int, max_pages: int, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Land all pages that are there and stop; a later call goes on where this one ended."""
    with _state_store(pages.sparkSession):
        return (
            taken_pages(pages, limit, max_pages, keys).writeStream.outputMode("append")
            .foreachBatch(lambda df, number: land_batch(df, number, out, keys))
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )


@contextmanager
def _state_store(spark: SparkSession):
    """The store that arbitrary state needs, for queries started inside; others keep theirs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    """(day, rows) as landed so far, days without rows filled in."""
    return fill_days(spark.read.schema("rows long, day date").parquet(f"{out}/daily").select("day", "rows"))

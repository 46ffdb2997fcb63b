"""The given tables, and the activity rows derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.session import prepare, stage_path

# Start of the event stream, in microseconds.
START_US = 1_704_067_200_000_000
DAY_US = 86_400_000_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _event_columns() -> dict:
    event, user = F.col("event_id"), F.col("user_id")
    base = event - event % 20
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return {
        "id": event.cast("string"),
        "author": F.when(user % 17 == 0, "[deleted]").otherwise(F.concat(F.lit("u"), user.cast("string"))),
        # Every account's month of events is squeezed into three days, and accounts start on
        # different days of a month.
        "created_dt": F.timestamp_micros(
            F.lit(START_US) + (user % 30) * F.lit(DAY_US) + F.floor((us - F.lit(START_US)) / 10)
        ),
        "kind": F.when(event % 20 == 0, "post").otherwise("comment"),
        "subreddit": F.col("event_type"),
        "score": F.round(F.col("value") * 100).cast("long"),
        "link_id": F.when(event % 20 == 0, F.lit(None)).when(event % 20 == 7, "t3_big").otherwise(
            F.concat(F.lit("t3_"), base.cast("string"))
        ),
        "parent_id": F.when(event % 20 == 0, F.lit(None)).when(
            event % 20 == 1, F.concat(F.lit("t3_"), base.cast("string"))
        ).otherwise(F.concat(F.lit("t1_"), (event - 1 - event % 3).cast("string"))),
    }


def activity(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Events as forum activity; ``text`` joins a document to every event."""
    events = table(spark, sf_dir, "events")
    columns = [expression.alias(name) for name, expression in _event_columns().items()]
    if not text:
        return events.select(*columns)
    docs = table(spark, sf_dir, "documents")
    count = docs.agg(F.count(F.lit(1))).scalar()
    keyed = events.select(*columns, (F.col("event_id") % count).alias("doc_id"))
    return keyed.join(docs.select("doc_id", "text"), "doc_id", "left").drop("doc_id")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: the source wrote them, one per minute, in the language's forum."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("author"),
        F.timestamp_micros(F.lit(START_US) + F.col("doc_id") * 60_000_000).alias("created_dt"),
        F.col("lang").alias("subreddit"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with position, account, time, forum and given label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("position"), F.col("vec_id").cast("string").alias("id"), "embedding",
        F.concat(F.lit("u"), (F.col("vec_id") % 20).cast("string")).alias("author"),
        F.timestamp_micros(F.lit(START_US) + F.col("vec_id") * 60_000_000).alias("created_dt"),
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("subreddit"),
        F.col("label").alias("semantic_cluster"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity in the shape the archive delivers it, with unclean authors and times."""
    seconds = F.expr("unix_micros(created_dt) div 1000000").cast("string")
    missing = F.col("author") == "[deleted]"
    return activity(spark, sf_dir, text=True).select(
        "id", F.when(~missing, F.col("author")).alias("author"),
        F.when(F.col("id").endswith("77"), "not-a-time").otherwise(seconds).alias("created_utc"),
        F.when(F.col("id").endswith("5"), "").otherwise(F.col("subreddit")).alias("subreddit"),
        "score", "kind", "link_id", "parent_id",
        F.concat(F.lit("Post   "), F.col("id")).alias("title"), "text",
    )


def land_raw(spark: SparkSession, sf_dir: str) -> str:
    """Write the raw rows as one posts and one comments file, plus an empty posts file."""
    folder = stage_path(spark, "raw")
    rows = raw_rows(spark, sf_dir)
    common = ["id", "author", "created_utc", "subreddit", "score"]
    posts = rows.where("kind = 'post'").select(*common, "title", F.col("text").alias("selftext"))
    comments = rows.where("kind = 'comment'").select(*common, F.col("text").alias("body"), "link_id", "parent_id")
    posts.write.parquet(f"{folder}/forum_posts.parquet")
    comments.write.parquet(f"{folder}/forum_comments.parquet")
    posts.where(F.lit(False)).write.parquet(f"{folder}/quiet_posts.parquet")
    return folder


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed into JSON pages of at most 100 rows, in all five envelope shapes."""
    rows = raw_rows(spark, sf_dir).select(
        F.floor(F.col("id").cast("long") / 100).alias("page"),
        F.struct("id", "author", "created_utc", "subreddit", "score", "link_id", "parent_id").alias("row"),
    )
    packed = rows.groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    body = F.to_json("rows")
    shape = F.col("page") % 5
    wrapped = F.when(shape == 0, body)
    for at, (head, tail) in enumerate(
        (('{"data":', "}"), ('{"results":', "}"), ('{"items":', "}"), ('{"data":{"children":', "}}")), start=1
    ):
        wrapped = wrapped.when(shape == at, F.concat(F.lit(head), body, F.lit(tail)))
    return packed.select("page", wrapped.alias("payload"))


def landed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event landed twice on different pages, some of them without an id."""
    events = activity(spark, sf_dir).select(
        F.when(~F.col("id").endswith("3"), F.col("id")).alias("id"), "author", "subreddit", "kind",
        F.col("id").cast("long").alias("event"),
        F.expr("unix_micros(created_dt) div 1000000").cast("string").alias("created_utc"),
    )
    return events.select(
        "id", "author", "subreddit", "kind", "created_utc",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "event",
    ).select(
        "id", "author", "subreddit", "kind", "created_utc",
        (F.floor(F.col("event") / 100) + F.col("copy") * 7).alias("page"),
        (F.col("event") % 100 + F.col("copy") * 100).alias("pos"), "copy",
    )

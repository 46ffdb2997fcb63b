"""Per-account features.

Shuffle plan: rows are pre-aggregated per (author, subreddit) and per (author, thread) before
anything is grouped by author, so an account holding a third of all rows arrives as a handful
of partial rows. Gaps between rows are taken second by second, hour by hour and then per account
for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.config import Settings
from murmuration.functions.text import topic_hit
from murmuration.session import write_stage

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
SECOND_US = 1_000_000
MINUTE_US = 60_000_000


def _us(column: str) -> Column:
    return F.unix_micros(column)


def topic_columns(settings: Settings) -> dict[str, Column]:
    return {f"topic_{t}_rate": topic_hit(F.col("text"), words) for t, words in settings.topics.items()}


def _gaps(valid: DataFrame) -> DataFrame:
    """(author, gap, n): gaps between an author's rows in microseconds, equal ones counted.

    Rows of one moment are counted first and give gaps of zero. Distinct moments are then looked
    at second by second; a second passes on its first and last moment to its hour, and an hour to
    the author. No group holds more than a second's moments, an hour's seconds or an account's
    hours, wherever a busy account puts its rows.
    """
    moments = valid.where(F.col("created_dt").isNotNull()).groupBy("author", _us("created_dt").alias("first")).agg(
        F.count(F.lit(1)).alias("n"))
    found = moments.where("n > 1").select("author", F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n"))
    level = moments.select("author", "first", F.col("first").alias("last"))
    for width in (SECOND_US, HOUR_US, None):
        bucket = [] if width is None else [F.floor(F.col("first") / width)]
        placed = level.withColumn("bucket", bucket[0] if bucket else F.lit(0))
        order = Window.partitionBy("author", "bucket").orderBy("first")
        gaps = placed.withColumn("gap", F.col("first") - F.lag("last").over(order)).where("gap is not null")
        found = found.unionByName(gaps.select("author", "gap", F.lit(1).cast("long").alias("n")))
        level = placed.groupBy("author", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("bucket")
    return found.groupBy("author", "gap").agg(F.sum("n").alias("n"))


def median_gaps(valid: DataFrame) -> DataFrame:
    """(author, median_interarrival_min): exact median of the gaps between an author's rows.

    Gaps are binned by size, at most a thousand bins for an account; the bins that hold the middle
    one or two gaps are found from the bins' counts, and only their gaps are put in order.
    """
    # Read twice below, so it is counted once and written: at most one row per gap of an author.
    counted = write_stage(_gaps(valid), "gaps").withColumn("bin", F.floor(F.log2(F.col("gap") + 1) * 16))
    bins = counted.groupBy("author", "bin").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy("author")
    placed = bins.withColumns({
        "upto": F.sum("held").over(whole.orderBy("bin")), "total": F.sum("held").over(whole)})
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")

    def holds(position: Column, upto: str, n: str) -> Column:
        return (F.col(upto) > position) & (F.col(upto) - F.col(n) <= position)

    middle = placed.where(holds(low, "upto", "held") | holds(high, "upto", "held")).select(
        "author", "bin", "total", (F.col("upto") - F.col("held")).alias("before"))
    inside = counted.join(middle, ["author", "bin"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(Window.partitionBy("author", "bin").orderBy("gap")))
    chosen = inside.where(holds(low, "upto", "n") | holds(high, "upto", "n")).groupBy("author").agg(
        F.min("gap").alias("lower"), F.max("gap").alias("upper"))
    return chosen.select(
        "author", ((F.col("lower") + F.col("upper")) / 2 / MINUTE_US).alias("median_interarrival_min")
    )


def account_features(valid: DataFrame, settings: Settings) -> DataFrame:
    """One row per author: counts, rates, flags, concentration, median gap and topic rates."""
    topics = topic_columns(settings)
    hits = [F.sum(hit.cast("long")).alias(name) for name, hit in topics.items()]
    per_place = valid.groupBy("author", "subreddit").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("id").alias("ids"),
        F.count_if(F.col("kind") == "post").alias("posts"),
        F.count_if(F.col("kind") == "comment").alias("comments"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_n"),
        F.min("created_dt").alias("first"),
        F.max("created_dt").alias("last"),
        *hits,
    )
    placed = F.when(F.col("subreddit").isNotNull(), F.col("rows"))
    base = per_place.groupBy("author").agg(
        F.sum("ids").alias("activity_count"),
        F.sum("posts").alias("post_count"),
        F.sum("comments").alias("comment_count"),
        F.count("subreddit").alias("subreddit_count"),
        (F.sum("score_sum") / F.nullif(F.sum("score_n"), F.lit(0))).alias("mean_score"),
        F.min("first").alias("author_first_seen"),
        F.max("last").alias("author_last_seen"),
        F.coalesce(F.max(placed) / F.sum(placed), F.lit(0.0)).alias("max_subreddit_share"),
        *[(F.sum(name) / F.sum("rows")).alias(name) for name in topics],
    )
    # Three steps read these columns; written once, they spare those steps whatever ``valid`` is made of.
    narrow = write_stage(valid.select("author", "link_id", "created_dt"), "account_rows")
    threads = (
        narrow.where(F.col("link_id").isNotNull()).select("author", "link_id").distinct()
        .groupBy("author").agg(F.count(F.lit(1)).alias("thread_count"))
    )
    # One value over all rows: an uncorrelated scalar subquery, never joined.
    latest = narrow.agg(F.max(_us("created_dt"))).scalar()
    span = (_us("author_last_seen") - _us("author_first_seen")) / DAY_US
    age = (latest - _us("author_first_seen")) / DAY_US
    joined = base.join(threads, "author", "left").join(median_gaps(narrow), "author", "left")
    return joined.select(
        "author", "activity_count", "post_count", "comment_count", "subreddit_count",
        F.coalesce("thread_count", F.lit(0)).alias("thread_count"),
        "mean_score", "author_first_seen", "author_last_seen",
        span.alias("observed_span_days"),
        F.when(span.isNotNull(), F.col("activity_count") / F.greatest(span, F.lit(1 / 24))).alias(
            "activity_per_observed_day"
        ),
        F.coalesce(age <= settings.very_new_account_days, F.lit(False)).alias("new_account_7d"),
        F.coalesce(age <= settings.new_account_days, F.lit(False)).alias("new_account_30d"),
        "max_subreddit_share", "median_interarrival_min",
        *topics,
    )


def subreddit_counts(valid: DataFrame) -> DataFrame:
    """(author, subreddit, rows): the crosstab in long form, for any number of subreddits."""
    return valid.where(F.col("subreddit").isNotNull()).groupBy("author", "subreddit").agg(F.count(F.lit(1)).alias("rows"))


def subreddit_crosstab(valid: DataFrame, subreddits: list[str] | None = None) -> DataFrame:
    """Row counts per author and subreddit, one column per subreddit.

    Without a list the columns are all subreddits found, in order; with one, rows of others are
    left out because the caller asks for it. A table has room for some thousands of columns
    (``spark.sql.pivotMaxValues`` sets the limit and more are an error); ``subreddit_counts`` has none.
    """
    if subreddits is None:
        long = subreddit_counts(valid)
        return long.groupBy("author").pivot("subreddit").agg(F.sum("rows")).na.fill(0)
    return valid.where(F.col("subreddit").isNotNull()).groupBy("author").pivot("subreddit", subreddits).agg(
        F.count(F.lit(1))
    ).na.fill(0)


def topic_rates(valid: DataFrame, settings: Settings) -> DataFrame:
    return valid.groupBy("author").agg(
        *[F.avg(hit.cast("int")).alias(name) for name, hit in topic_columns(settings).items()]
    )


def topic_summary(features: DataFrame) -> DataFrame:
    """(topic, mean_rate): unweighted mean over accounts, lowest first."""
    names = [c for c in features.columns if c.startswith("topic_") and c.endswith("_rate")]
    if not names:
        return features.sparkSession.createDataFrame([], "topic string, mean_rate double")
    means = features.agg(*[F.avg(c).alias(c[len("topic_"):-len("_rate")]) for c in names])
    return means.unpivot([], means.columns, "topic", "mean_rate").orderBy("mean_rate", "topic")


def feature_preview(features: DataFrame, rows: int = 25) -> DataFrame:
    return features.orderBy(F.desc("new_account_7d"), F.desc("activity_count"), "author").limit(rows)

"""Daily series with empty days filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.session import write_stage


def _day(column: str) -> Column:
    return F.to_date(column)


def fill_days(per_day: DataFrame) -> DataFrame:
    """Add a row of zeros for every missing day between the first and the last one.

    Every day is unfolded up to the day before the next one, so ``per_day`` is read once and
    joined with nothing. It holds one row per calendar day, which one task can put in order.
    """
    counts = [c for c in per_day.columns if c != "day"]
    following = F.lead("day").over(Window.orderBy("day"))
    until = F.coalesce(F.date_sub(following, 1), F.col("day"))
    days = per_day.withColumn("until", until).withColumn(
        "filled", F.explode(F.sequence("day", "until", F.expr("interval 1 day")))
    )
    return days.select(
        F.col("filled").alias("day"), *[F.when(F.col("filled") == F.col("day"), F.col(c)).otherwise(0).alias(c) for c in counts]
    )


def daily_activity(activity: DataFrame) -> DataFrame:
    """(day, rows), deleted authors included, 0 on days without rows."""
    per_day = activity.where(F.col("created_dt").isNotNull()).groupBy(_day("created_dt").alias("day")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return fill_days(per_day)


def new_account_daily_share(activity: DataFrame, very_new_days: int, new_days: int) -> DataFrame:
    """Rows per day by authors first seen at most ``very_new_days`` / ``new_days`` before.

    Rows are counted per (author, day). For each limit an author has exactly one day that the
    limit cuts through; on earlier days all rows count, on later days none do. Only rows of
    those cut days are looked at one by one, joined on (author, day), so the pooled
    ``[deleted]`` author never sits in one task.
    """
    rows = activity.where(F.col("created_dt").isNotNull()).select(
        "author", "created_dt", _day("created_dt").alias("day")
    )
    per_author_day = rows.groupBy("author", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_dt").alias("first_row")
    )
    first = F.min("first_row").over(Window.partitionBy("author"))
    limits = {"new_7d": very_new_days, "new_30d": new_days}
    # Read twice below, so it is counted once and written: one row per author and active day.
    dated = write_stage(per_author_day.withColumn("first_seen", first).withColumns({
        f"{name}_until": F.col("first_seen") + F.make_dt_interval(days=F.lit(days)) for name, days in limits.items()
    }), "author_days")
    cut = {name: F.col("day") == F.to_date(f"{name}_until") for name in limits}
    whole = dated.groupBy("day").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("day") < F.to_date(f"{n}_until"), F.col("n")).otherwise(0)).alias(n) for n in limits],
    )
    cut_days = dated.where(cut["new_7d"] | cut["new_30d"]).select(
        F.col("author").alias("cut_author"), F.col("day").alias("cut_day"),
        *[F.when(cut[n], F.col(f"{n}_until")).alias(f"{n}_until") for n in limits],
    )
    on_cut_days = rows.join(
        cut_days, (F.col("author") == F.col("cut_author")) & (F.col("day") == F.col("cut_day"))
    ).groupBy("day").agg(
        F.lit(0).cast("long").alias("total"),
        *[F.count_if(F.col("created_dt") <= F.col(f"{n}_until")).alias(n) for n in limits],
    )
    per_day = whole.unionByName(on_cut_days).groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("total", *limits)]
    )
    filled = fill_days(per_day)
    share = {n.replace("new", "share"): F.col(n) / F.nullif(F.col("total"), F.lit(0)) for n in limits}
    return filled.withColumns(share)

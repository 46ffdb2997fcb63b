"""Landed pages: envelope flattening, id dedupe and the resume cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.schemas import LANDED_ROW
from murmuration.session import write_stage

# Places in a page where the row array may sit, in order of preference.
ARRAY_PATHS = ("$", "$.data", "$.results", "$.items", "$.data.children")


def page_rows(payload: Column) -> Column:
    """Array of JSON rows inside a page; null where the page holds none."""
    page = F.try_parse_json(payload)
    return F.coalesce(*[F.try_variant_get(page, path, "array<variant>") for path in ARRAY_PATHS])


def flatten_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per element, with its position in the page and the declared columns."""
    exploded = pages.select(
        *[c for c in pages.columns if c != payload],
        F.posexplode(page_rows(F.col(payload))).alias("pos", "element"),
    )
    fields = [
        F.try_variant_get("element", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in LANDED_ROW.fields
    ]
    return exploded.select(*[c for c in exploded.columns if c != "element"], *fields)


def flatten_keyed(pages: DataFrame, keys: tuple[str, ...] = ("kind", "subreddit")) -> DataFrame:
    """Flattened pages that keep their own subreddit where it is one of the keys."""
    if "subreddit" not in keys:
        return flatten_pages(pages)
    return flatten_pages(pages.withColumnRenamed("subreddit", "_of")).drop("subreddit").withColumnRenamed("_of", "subreddit")


def page_stats(payload: Column) -> tuple[Column, Column]:
    """Number of rows in a page (0 where it holds none) and their latest created second, row by row."""
    rows = page_rows(payload)
    created = F.transform(rows, lambda r: F.try_variant_get(r, "$.created_utc", "string").try_cast("double"))
    return F.coalesce(F.size(rows), F.lit(0)), F.array_max(created)


def keep_first(rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """First row per id in landing order; rows without id all stay.

    The rank is cut to 1, so Spark drops later copies before the shuffle and a third of all
    rows sharing one id costs one surviving row per input partition.
    """
    named = rows.where(F.col(key).isNotNull())
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = named.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.unionByName(rows.where(F.col(key).isNull()))


def resume_cursor(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Next start second per key: just after the latest whole second seen so far."""
    latest = F.max(F.col("created_utc").cast("string").try_cast("double"))
    return rows.groupBy(*keys).agg((F.floor(latest) + 1).cast("string").alias("next_after")).where(
        F.col("next_after").isNotNull()
    )


def usable_pages(pages: DataFrame, limit: int, max_pages: int, keys: list[str], page: str = "page") -> DataFrame:
    """Pages a resumable load would have consumed, per key, as (keys, page).

    A load ends after a page without any created value, after one whose latest value repeats
    the previous page's, after a page shorter than ``limit``, and at ``max_pages``; an empty
    page ends it before being used. Input rows are flattened rows with ``page`` and ``pos``.
    """
    stats = pages.groupBy(*keys, page).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.col("created_utc").cast("string").try_cast("double")).alias("latest"),
    )
    # One row per page from here on, so a window over a key holds at most ``max_pages`` of note.
    order = Window.partitionBy(*keys).orderBy(page)
    ends = (
        F.col("latest").isNull()
        | F.coalesce(F.col("latest") == F.lag("latest").over(order), F.lit(False))
        | (F.col("rows") < limit)
    )
    numbered = stats.withColumns({"_nth": F.row_number().over(order), "_ends": ends.cast("int")})
    before = F.coalesce(F.sum("_ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.col(page) - F.first(page).over(order) + 1 == F.col("_nth")
    return numbered.withColumns({"_before": before, "_dense": gap}).where(
        (F.col("_before") == 0) & F.col("_dense") & (F.col("_nth") <= max_pages)
    ).select(*keys, page)


def new_rows(pages: DataFrame, limit: int, max_pages: int, cursor: DataFrame | None = None,
             keys: tuple[str, ...] = ("kind", "subreddit")) -> DataFrame:
    """Rows a resumed load takes from landed pages: usable pages only, from the cursor on, once per id.

    ``pages`` has the keys, ``page`` and ``payload``; ``cursor`` is what ``resume_cursor`` gave
    for earlier pages. Rows without a readable time are taken whatever the cursor says.
    """
    flat = flatten_keyed(pages, keys)
    used = usable_pages(flat, limit, max_pages, list(keys))
    taken = flat.join(used, [*keys, "page"], "left_semi")
    if cursor is not None:
        created = F.col("created_utc").cast("string").try_cast("double")
        start = F.col("next_after").try_cast("double")
        taken = taken.join(cursor, list(keys), "left").where(
            start.isNull() | created.isNull() | (created >= start)).drop("next_after")
    return keep_first(taken, ["page", "pos"])


def land_pages(pages: DataFrame, raw_dir: str, limit: int, max_pages: int, cursor: DataFrame | None = None,
               batch: str = "landed") -> DataFrame:
    """Write the new rows of landed pages as raw tables, one per kind; returns the next cursor.

    ``batch`` names this load, so that later ones add to the folder instead of replacing it.
    """
    rows = write_stage(new_rows(pages, limit, max_pages, cursor), "landed")
    for kind, name in (("post", "posts"), ("comment", "comments")):
        rows.where(F.col("kind") == kind).drop("kind", "page", "pos").write.parquet(f"{raw_dir.rstrip('/')}/{batch}_{name}.parquet")
    return resume_cursor(rows if cursor is None else rows.select("kind", "subreddit", "created_utc").unionByName(
        cursor.select("kind", "subreddit", (F.col("next_after").try_cast("long") - 1).cast("string").alias("created_utc"))),
        ["kind", "subreddit"])

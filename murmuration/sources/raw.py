"""Parquet, CSV and page-envelope sources, and the sinks that mirror them."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from murmuration.config import DELETED
from murmuration.functions import text as X
from murmuration.schemas import PREFERRED_COLUMNS

KINDS = ("posts", "comments")

# Column holding the name of the raw file while rows are read.
FILE = "_raw_file"

# Columns later steps read from activity besides those attached here.
ACTIVITY_COLUMNS = {"id": "string", "subreddit": "string", "link_id": "string", "parent_id": "string", "score": "long"}


def _globs(raw_dir: str, kinds=KINDS) -> list[str]:
    return [f"{raw_dir.rstrip('/')}/*_{kind}.parquet" for kind in kinds]


def _file_name() -> Column:
    """Name of the raw file (or of the folder Spark wrote in its place) a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)(?:/[^/]*)?$", 1)


def raw_files(spark: SparkSession, raw_dir: str, kinds=KINDS) -> DataFrame:
    """Names of all raw files, empty ones included. Only the listing is read, no content."""
    listing = None
    for glob in _globs(raw_dir, kinds):
        try:
            part = spark.read.format("binaryFile").load(glob).select(
                F.regexp_extract("path", r"([^/]+_(?:posts|comments)\.parquet)(?:/[^/]*)?$", 1).alias("file")
            )
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        listing = part if listing is None else listing.unionByName(part)
    if listing is None:
        return spark.createDataFrame([], "file string")
    return listing.where(F.col("file") != "").distinct()


def _parquet(spark: SparkSession, *paths: str) -> DataFrame:
    part = spark.read.option("mergeSchema", "true").parquet(*paths)
    return part.withColumn(FILE, _file_name())


def _by_types(spark: SparkSession, glob: str) -> DataFrame | None:
    """Files whose columns disagree in type: read per set of types, disagreeing columns as text.

    Only file names come to the driver, one per raw file, and each file's footer is read once.
    """
    listed = spark.read.format("binaryFile").load(glob).select("path").distinct().orderBy("path")
    groups: dict[str, list[str]] = {}
    for row in listed.toLocalIterator():
        groups.setdefault(spark.read.parquet(row["path"]).schema.json(), []).append(row["path"])
    parts = [_parquet(spark, *paths) for paths in groups.values()]
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {name for name, found in kinds.items() if len(found) > 1}
    united = None
    for part in parts:
        plain = part.withColumns({c: F.col(c).cast("string") for c in part.columns if c in mixed})
        united = plain if united is None else united.unionByName(plain, allowMissingColumns=True)
    return united


def _read_kind(spark: SparkSession, raw_dir: str, kind: str, schema: T.StructType | None) -> DataFrame | None:
    """Rows of one kind with the name of their file; None without any file.

    Files may hold one column in different types (times as text in one, as a number in another).
    With ``schema`` columns are brought to its types, unreadable values becoming null.
    """
    (glob,) = _globs(raw_dir, (kind,))
    try:
        part = _parquet(spark, glob)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    except (PySparkException, Py4JJavaError) as error:  # the reader's own error arrives unwrapped
        if "CANNOT_MERGE_SCHEMA" not in str(error):
            raise
        part = _by_types(spark, glob)
    if schema is None or part is None:
        return part
    have = set(part.columns)
    return part.select(FILE, *[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_raw(spark: SparkSession, raw_dir: str, schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """Rows of every ``*_posts`` and ``*_comments`` file, united by column name.

    ``kind`` comes from the file name. ``schemas`` (one per kind, see ``schemas.RAW_POSTS``)
    fixes columns and types whatever the files hold.
    """
    united = None
    for kind in KINDS:
        part = _read_kind(spark, raw_dir, kind, (schemas or {}).get(kind))
        if part is None:
            continue
        tagged = part.withColumn("kind", F.when(F.col(FILE).contains("_posts"), "post").otherwise("comment")).drop(FILE)
        if united is not None:
            tagged, united = _same_types(tagged, united)
        united = tagged if united is None else united.unionByName(tagged, allowMissingColumns=True)
    if united is None:
        raise FileNotFoundError("No raw parquet files. Land posts or comments first.")
    return united


def _same_types(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of both frames whose types disagree, as text."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    mixed = [c for c in left if c in right and left[c] != right[c]]
    text = {c: F.col(c).cast("string") for c in mixed}
    return (a.withColumns(text), b.withColumns(text)) if mixed else (a, b)


def normalize_activity(raw: DataFrame) -> DataFrame:
    """Attach author, ``created_dt`` and ``text``; absent columns count as null."""
    have = set(raw.columns)
    absent = {c: kind for c, kind in ACTIVITY_COLUMNS.items() if c not in have}
    raw = raw.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items()})
    null = F.lit(None).cast("string")
    pick = {c: (F.col(c) if c in have else null) for c in ("title", "selftext", "body")}
    numeric = isinstance(raw.schema["author"].dataType, T.NumericType)
    return raw.withColumns({
        "author": X.clean_author(F.col("author"), numeric),
        "created_dt": X.epoch_to_timestamp(F.col("created_utc")),
        "text": X.activity_text(F.col("kind"), pick["title"], pick["selftext"], pick["body"]),
    })


def load_raw(spark: SparkSession, raw_dir: str, schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    return normalize_activity(read_raw(spark, raw_dir, schemas))


def valid_activity(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("author") != DELETED)


def eligible_activity(activity: DataFrame, min_text_chars: int) -> DataFrame:
    """Rows long enough to compare, with their normalised text."""
    long_enough = valid_activity(activity).where(F.length("text") >= min_text_chars)
    return X.add_norm_text(long_enough)


def add_day(activity: DataFrame) -> DataFrame:
    """Activity with its ``day``, the column it is partitioned by when written."""
    return activity.withColumn("day", F.to_date("created_dt"))


def activity_window(activity: DataFrame, subreddits: str | Iterable[str] | None = None, after=None, before=None) -> DataFrame:
    """Subreddits and time range, ``after`` included and ``before`` not.

    Where the table has its ``day`` (see ``add_day``) the range is put on that as well, so whole
    partitions are skipped; the subreddit filter reaches the file scan.
    """
    out = activity
    if subreddits:
        names = [subreddits] if isinstance(subreddits, str) else list(subreddits)
        out = out.where(F.col("subreddit").isin(names))
    for bound, later in ((after, True), (before, False)):
        if bound is None:
            continue
        at = F.lit(bound).cast("timestamp")
        out = out.where(F.col("created_dt") >= at if later else F.col("created_dt") < at)
        if "day" in activity.columns:
            out = out.where(F.col("day") >= F.to_date(at) if later else F.col("day") <= F.to_date(at))
    return out


def subreddit_of_file(name: Column, kind: str) -> Column:
    return F.regexp_replace(name, rf"(_{kind})?\.parquet$", "")


def load_kind(spark: SparkSession, raw_dir: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """One kind for publication: blank subreddits filled from the file name, known columns first."""
    part = _read_kind(spark, raw_dir, kind, schema)
    if part is None:
        return spark.createDataFrame([], "id string")
    from_file = subreddit_of_file(F.col(FILE), kind)
    if "subreddit" in part.columns:
        kept = F.col("subreddit").cast("string")
        filled = part.withColumn("subreddit", F.when(F.trim(kept) != "", kept).otherwise(from_file))
    else:
        filled = part.withColumn("subreddit", from_file)
    first = [c for c in PREFERRED_COLUMNS[kind] if c in filled.columns]
    return filled.select(*first, *[c for c in filled.columns if c not in first and c != FILE])


def kind_counts(spark: SparkSession, raw_dir: str, kinds=KINDS) -> DataFrame:
    """Rows per raw file, zero for empty files: (kind, file, rows)."""
    listed = raw_files(spark, raw_dir, kinds)
    counted = None
    for kind in kinds:
        part = _read_kind(spark, raw_dir, kind, None)
        if part is None:
            continue
        one = part.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        counted = spark.createDataFrame([], "file string, n long")
    kind_of = F.when(F.col("file").endswith("_posts.parquet"), "posts").otherwise("comments")
    return listed.join(counted, "file", "left").select(
        kind_of.alias("kind"), "file", F.coalesce("n", F.lit(0)).alias("rows")
    )


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_days(df: DataFrame, path: str, *further: str, day: str = "day") -> None:
    """Rewrite the days (and further partition columns) that ``df`` holds; all other files stay.

    A second run over one day replaces that day only. A day that has lost all its rows is not
    among those of ``df`` and stays as it was. Rows are dealt by day and split where a day is large.
    """
    dealt = df.hint("rebalance", day, *further)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, *further).parquet(path)


def write_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV folder with header, key column first."""
    ordered = df.select(key, *[c for c in df.columns if c != key]) if key else df
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)

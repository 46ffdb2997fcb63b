"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan in this package relies on. Partition counts and memory stay
# with whoever owns the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "murmuration", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the executors
    would not see it, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="murmuration-"))
    return context.getCheckpointDir().rstrip("/")


# Folders written on behalf of the run this thread is in; outside a run they have no owner.
_RUN: ContextVar[list[str] | None] = ContextVar("stages", default=None)
_UNOWNED: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    """A new folder for an intermediate table, registered with the run that asks for it."""
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    owner = _RUN.get()
    (_UNOWNED if owner is None else owner).append(path)
    return path


def write_stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing rounds), and
    gives the optimiser real file sizes for the next join.
    """
    path = stage_path(df.sparkSession, label)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    paths.clear()


@contextmanager
def stages_removed(spark: SparkSession):
    """Delete the intermediate tables written inside the block once it has ended.

    Every block owns its tables, so runs in several threads leave each other's alone. Only for
    blocks that write their results themselves: lazy results still read those tables.
    """
    own: list[str] = []
    token = _RUN.set(own)
    try:
        yield
    finally:
        _RUN.reset(token)
        _delete(spark, own)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``write_stage`` made, once what was read from them is written elsewhere."""
    for df in frames:
        folder = f"{shared_folder(df.sparkSession)}/tables/"
        found = {f[:f.index("/", f.index(folder) + len(folder))] for f in df.inputFiles() if folder in f}
        _delete(df.sparkSession, sorted(found))


def release_stages(spark: SparkSession) -> None:
    """Delete the tables written outside any block, once nothing lazy reads them any more."""
    _delete(spark, _UNOWNED)


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for CPU-heavy steps that must not be merged into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)

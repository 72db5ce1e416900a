"""Intermediate tables in the shared checkpoint folder.

A staged table cuts lineage, is read back with known file sizes (so the planner broadcasts it only when it really is
small) and survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names in `spark.checkpoint.dir`; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logquarry-"))
    return context.getCheckpointDir().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists; nothing below it is listed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it; None if it is of another file system than the local one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def plain_folder(spark: SparkSession, path: str) -> str:
    """A local folder without scheme, however its URI is written; any other as it is."""
    return local_path(spark, path) or path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# What a staged table may hold to be sent to every executor.
ROWS_TO_BROADCAST, BYTES_TO_BROADCAST = 500_000, 64 << 20


def broadcast_if_small(staged: DataFrame, limit: int | None = None) -> DataFrame:
    """A staged table, marked for broadcast when its rows and their bytes are within the limits; else unchanged.

    Texts count with their bytes, other columns as 16 bytes. The rows are the same either way.
    """
    if staged.count() > (ROWS_TO_BROADCAST if limit is None else limit):
        return staged
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(16) for c, kind in staged.dtypes]
    total = staged.agg(F.sum(sum(sizes, F.lit(16)))).first()[0] or 0
    return F.broadcast(staged) if total <= BYTES_TO_BROADCAST else staged


def only_wanted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose keys occur in a staged table; a small table goes to the rows."""
    return rows.join(broadcast_if_small(wanted.select(*keys)), keys, "left_semi").select(*rows.columns)


# Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The folders written so far by the work whose tables are deleted at its end.
PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for the queries that run meanwhile; then those from before."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return the table read back. What the write has shuffled is removed with its end, so the disk
    holds staged tables and the shuffles of one write."""
    return written(df, name, {})


def stage_large_rows(df: DataFrame, name: str) -> DataFrame:
    """`stage` for rows of some MB each. A task that writes or reads a row group holds it whole in memory, and by size alone
    Parquet ends none before it has a hundred rows; here each row is a row group of its own."""
    return written(df, name, {"parquet.block.row.count.limit": "1"})


def written(df: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    target = new_folder(spark, name)
    if PASSING.get() is not None:
        PASSING.get().append(target)
    with settings(spark, {CLEANUP: "true"}):
        df.write.options(**options).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def stage_last(work: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what `work` returns and delete all that it has staged; nothing else may read these tables."""
    outer = PASSING.set([])
    try:
        df = work()
        passed = PASSING.get()
    finally:
        PASSING.reset(outer)
    last = stage(df, name)
    for folder in passed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return last

"""What the operators of this subpackage share: queries, input columns, running sums, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A word is a run of characters other than ASCII white space, in Java's and in Python's pattern syntax.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is; the quick form serves texts that are ASCII throughout."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def small(staged: DataFrame, rows: int) -> DataFrame:
    """A written table of narrow rows, marked for broadcast when it has at most `rows` rows; otherwise left to a
    shuffled join with the same result."""
    return F.broadcast(staged) if staged.count() <= rows else staged


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of `value` over the rows of the same keys that come before, in the order of `block`, then `order`.

    Each (keys, block) is one window group; one row per block carries the sums on, so no key is gathered in one task.
    """
    source = df.withColumn("__block", block)
    totals = source.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__at"),
        F.coalesce(F.sum("__total").over(blocks), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = source.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("__block") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(carried, same).select(*df.columns, (F.col("__local") + F.col("__carried")).alias(out))


def extended(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The types of the columns `keep` and of those in the declaration `more`."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def arrow_batches(
    df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], Iterator[dict]], slice_bytes: int = 4 << 20,
) -> DataFrame:
    """`work` over Arrow batches that are cut so that each holds about `slice_bytes` of input or a single row.

    A single row of any size is one batch; memory follows the longest row, not the number of rows of a batch.
    """
    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            step = max(1, int(rows * slice_bytes / max(batch.nbytes, 1)))
            for at in range(0, rows, step):
                for columns in work(batch.slice(at, step)):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)

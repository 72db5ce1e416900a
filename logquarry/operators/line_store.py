"""Numbered lines as a stored table with a sparse index, so that a page of a log reads only the parts that hold it.

`lines/` holds the lines in the order of file and number, in parts of bounded length. `index/` has one row for each file
and part: its first and last line. A page looks up its parts in the index and reads these; how long the log is, or how
many others are stored, does not change what a page reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logquarry.operators.explore import PAGE_CHARS, PAGE_LINES
from logquarry.sources.text_logs import lines_of

PART_LINES = 250_000
PLACE = ["file_path", "line_no"]


def store_lines(lines: DataFrame, folder: str, part_lines: int = PART_LINES) -> str:
    """Write numbered lines and their index below `folder`, which must not hold any yet. The order is by ranges of file
    and number, so one long log is written by many tasks."""
    ordered = lines_of(lines).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    ordered.write.option("maxRecordsPerFile", part_lines).parquet(f"{folder}/lines")
    written = lines.sparkSession.read.schema(ordered.schema).parquet(f"{folder}/lines")
    # Two narrow columns of what was written; the name of a part is kept as the reader gives it.
    written.groupBy("file_path", F.col("_metadata.file_path").alias("part")).agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).repartitionByRange("file_path").write.parquet(
        f"{folder}/index")
    return folder


def line_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, part, first_line, last_line) of stored lines."""
    return spark.read.schema("file_path string, part string, first_line long, last_line long").parquet(f"{folder}/index")


def longest_log(spark: SparkSession, folder: str) -> str | None:
    """The stored log with the most lines, of equal ones the first by name; the lines are not read."""
    row = line_index(spark, folder).groupBy("file_path").agg(F.max("last_line").alias("n")).orderBy(
        F.desc("n"), "file_path").first()
    return row["file_path"] if row else None


def stored_page(spark: SparkSession, folder: str, file_path: str, limit: int = PAGE_LINES, offset: int = 0,
                max_chars: int = PAGE_CHARS) -> DataFrame:
    """The `limit` lines of one log before its last `offset` ones, with the columns of `explore.page`.

    A page overlaps at most `limit` parts; their names are all that the driver gets. A log that is not stored, or has no
    more than `offset` lines, gives no rows.
    """
    of_file = line_index(spark, folder).where(F.col("file_path") == file_path)
    total = of_file.agg(F.max("last_line")).first()[0] or 0
    end = total - offset
    start = max(0, end - limit) + 1
    wanted = of_file.where(F.col("last_line").between(start, end) | F.col("first_line").between(start, end) | (
        (F.col("first_line") < start) & (F.col("last_line") > end))) if end >= start else of_file.limit(0)
    parts = [r["part"] for r in wanted.select("part").collect()]
    schema = spark.read.parquet(f"{folder}/lines").schema
    # Names come from the reader and are given back to it as they are, without escapes.
    names = [p.replace("%20", " ").replace("%25", "%") for p in parts]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows.where((F.col("file_path") == file_path) & F.col("line_no").between(start, end)).select(
        "file_path", "module", "line_no", F.substring("line", 1, max_chars).alias("line"),
        F.lit(start).cast("long").alias("start_line"), F.lit(total).cast("long").alias("total_lines"),
        F.lit(start > 1).alias("has_more"), F.lit(offset + end - start + 1).cast("long").alias("next_offset"))

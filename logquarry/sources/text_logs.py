"""Log sources: text files as numbered lines, whole texts as rows, and tables that hold one text per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.text import split_lines
from logquarry.schema import FINDINGS, LINES, conform
from logquarry.sources.tables import gathered
from logquarry.staging import broadcast_if_small, path_exists, stage


def plain_path(path: Column, encoded: bool = True) -> Column:
    """A file's path as a user writes it: without the scheme of local files, and without escapes."""
    if encoded:
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "/")


def scan_text(spark: SparkSession, paths: list[str], module: str | None = None) -> DataFrame:
    """Numbered lines of text files or folders (walked recursively); bad bytes become U+FFFD."""
    return scan(spark, paths, module)[0]


def scan(spark: SparkSession, paths: list[str], module: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered lines, and the (file_path) that gave any. A file that cannot be read gives none and stops nothing.

    Files are read in splits. Each row knows its split and its running id there, so the number of a line is the number
    of lines in earlier splits plus its distance from the first id of its own split. Only the small table of splits is
    aggregated; the text itself is not shuffled. Both passes must cut the files alike: where executors come and go,
    `spark.sql.files.minPartitionNum` fixes the cut, and a different one ends the query instead of misnumbering lines.
    """
    raw = gathered(
        spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(paths)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.monotonically_increasing_id().alias("row_id"),
            F.col("value"),
        )
    )
    splits = stage(
        raw.groupBy("file_path", "split_start").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_lines")),
        "splits",
    )
    earlier = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    # A window over one row per split of a file: a file of 30 TB in splits of 128 MB has 250 000.
    starts = broadcast_if_small(splits.withColumn("lines_before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))))
    distance = F.col("row_id") - F.col("first_id")
    line_no = F.when(
        (distance >= 0) & (distance < F.col("n_lines")), F.col("lines_before") + distance + 1
    ).otherwise(F.raise_error(F.lit("files were split differently between two passes")).cast("long"))
    lines = raw.join(starts, ["file_path", "split_start"], "left").select(
        plain_path(F.col("file_path")).alias("file_path"),
        F.lit(module).cast("string").alias("module"),
        F.lit(None).cast("string").alias("pipeline"),
        F.col("mtime").cast("timestamp").alias("mtime"),
        line_no.alias("line_no"),
        F.make_valid_utf8("value").alias("line"),
    )
    return lines, splits.select(plain_path(F.col("file_path")).alias("file_path")).distinct()


def explode_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines of a table with one whole text per row (file_path, module, pipeline, mtime, text)."""
    keep = ["file_path", "module", "pipeline", "mtime"]
    return unfold(texts, keep, split_lines(F.col(text)), "line", "pos").select(
        *keep, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def lines_of(df: DataFrame) -> DataFrame:
    return conform(df, LINES)


def existing_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Requested paths that exist, and those that are missing."""
    found = [p for p in paths if path_exists(spark, p)]
    return found, [p for p in paths if p not in found]


def missing_path_notifications(spark: SparkSession, missing: list[str]) -> DataFrame:
    rows = [("error", "Source path missing", f"Path {p} does not exist") for p in missing]
    return spark.createDataFrame(rows, "level string, title string, detail string").withColumn(
        "created_at", F.current_timestamp())


def listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every non-empty file below the paths with its size; contents are not read."""
    return gathered(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        .select(plain_path(F.col("path"), encoded=False).alias("file_path"), F.col("length"),
                F.col("modificationTime").cast("timestamp").alias("mtime"))
    )


def unreadable_file_findings(files: DataFrame, read: DataFrame, pipeline: Column, reason: str = "unreadable") -> DataFrame:
    """One ERROR finding per non-empty file that is not among those read; `pipeline` is its rule set by its path."""
    silent = files.where(F.col("length") > 0).join(read.select("file_path"), "file_path", "left_anti")
    return conform(
        silent.select(
            pipeline.alias("pipeline_name"),
            "file_path",
            F.lit(0).alias("finding_index"),
            F.lit("ERROR").alias("severity"),
            F.lit(f"failed to read file: {reason}").alias("message"),
            F.lit(1).alias("line_start"),
            F.lit(1).alias("line_end"),
            F.array().cast("array<string>").alias("excerpt"),
            F.lit(False).alias("needs_llm"),
            F.lit(False).alias("anomaly_flag"),
            F.col("mtime").alias("created_at"),
        ),
        FINDINGS,
    )


def glob_test(path: Column, patterns: list[str]) -> Column:
    """True where a path relative to its root matches one of the glob patterns (`**` spans folders)."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns])


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(pattern[i] if pattern[i].isalnum() or pattern[i] in "/_" else "\\" + pattern[i])
            i += 1
    return "^" + "".join(out) + "$"


# Files that a documentation source reads when none are named.
DEFAULT_DOC_PATTERNS = ["**/*.md", "**/*.rst", "**/*.txt"]


def scan_documentation(
    spark: SparkSession, root: str, repo_id: str, commit_hash: str, patterns: list[str] | None = None
) -> DataFrame:
    """Documentation files of one checked-out repository as whole texts; hidden files and folders are left out.

    File names are filtered while listing, so files of other kinds are never opened.
    """
    patterns = patterns or DEFAULT_DOC_PATTERNS
    names = ",".join(sorted({p.rsplit("/", 1)[-1] for p in patterns}))
    relative = F.regexp_replace("path", "^" + glob_root(root) + "/+", "")
    return gathered(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + names + "}").load(root)
        .select(plain_path(F.col("path"), encoded=False).alias("path"), "content")
        .where(glob_test(relative, patterns) & ~relative.rlike(r"(?:^|/)\."))
        .select(
            F.lit(repo_id).alias("repo_id"),
            F.col("path").alias("file_path"),
            F.lit(commit_hash).alias("commit_hash"),
            F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("content"),
        )
    )


def glob_root(root: str) -> str:
    plain = root.rstrip("/").removeprefix("file:")
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in plain)

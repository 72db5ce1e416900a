"""The given tables, and the views that let them stand for logs, findings, messages and documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logquarry.functions.text import split_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores where the files offer too few splits for them; otherwise leave the scan alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, key)


# Splits of files that a core or a task takes, at most, before tasks take several.
SPLITS_A_CORE, SPLITS_A_TASK = 32, 64


def gathered(df: DataFrame) -> DataFrame:
    """Let tasks take several splits where there are very many. Spark counts a file as 4 MB at least, so a split holds some 30
    small files, and to start a task for it takes about as long as to read them. Splits stay as they are cut."""
    splits = df.rdd.getNumPartitions()
    tasks = max(SPLITS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS_A_TASK))
    return df.coalesce(tasks) if splits > tasks else df


# Folders that files of one text each are dealt over. Spark lists each of them in one task; the one folder above them is
# listed by the driver, so it must not hold a folder for each text.
FILE_FOLDERS = 256


def file_folder(key: str) -> Column:
    return F.pmod(F.hash(key), F.lit(FILE_FOLDERS))


def minutes_into_2024(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def document_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is a log file: file_path, module (its source), pipeline (its language), mtime, text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".log")).alias("file_path"),
        F.col("source").alias("module"),
        F.col("lang").alias("pipeline"),
        minutes_into_2024(F.col("doc_id")).alias("mtime"),
        "text", "doc_id",
    )


def document_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The same logs with their lines as one array per row."""
    logs = document_logs(spark, folder)
    return logs.select("file_path", "module", "pipeline", "mtime", split_lines(F.col("text")).alias("body"), "doc_id")


def event_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Each event is a stored finding; the user decides the module and the file."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("m"), F.col("user_id") % 10).alias("module_name"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("pipeline_name"),
        F.concat(F.lit("/var/log/u"), "user_id", F.lit(".log")).alias("file_path"),
        F.col("event_id").alias("finding_index"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").when(kind == "signup", "CRITICAL")
        .when(kind == "click", "warning").otherwise("INFO").alias("severity"),
        F.concat(kind, F.lit(" "), "props").alias("message"),
        F.floor("value").cast("long").alias("line_start"),
        F.floor("value").cast("long").alias("line_end"),
        kind.alias("rule_id"),
        F.array("props", F.concat(F.lit("type="), kind)).alias("excerpt"),
        F.lit(False).alias("anomaly_flag"),
        F.lit(False).alias("needs_llm"),
        F.lit(None).cast("string").alias("llm_provider"),
        F.lit(None).cast("string").alias("llm_model"),
        F.lit(None).cast("string").alias("llm_response_content"),
        F.lit(None).cast("string").alias("llm_error"),
        F.lit(None).cast("long").alias("llm_prompt_tokens"),
        F.lit(None).cast("long").alias("llm_completion_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )

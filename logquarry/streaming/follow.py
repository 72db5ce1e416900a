"""Following logs: arrived segments become findings as they come in.

A collector delivers closed segments of each log: text files in a landing folder, or rows of a landing table. A segment
is one arrival. Its lines are numbered after those before it, its first findings may quote the last lines before it, and
finding numbers go on per module. These places are tables (`places`). Classifying a segment is a projection of its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logquarry.functions.text import split_lines
from logquarry.operators.classify import find_in_texts
from logquarry.operators.payloads import alert_records, needs_model, with_payload
from logquarry.operators.store import IDENTITY, append
from logquarry.sources.text_logs import plain_path
from logquarry.schema import FINDINGS, conform
from logquarry.spec import Module, RuleSet
from logquarry.staging import stage
from logquarry.streaming.places import Places

SEGMENTS = "module string, file_path string, pipeline string, generation long, segment long, arrived timestamp, text string"

def text_segments(spark: SparkSession, folder: str, pipeline: str, max_files: int | None = None) -> DataFrame:
    """Stream of text files `<folder>/<module>/<generation>/<segment>.<suffix>`, one file per segment."""
    reader = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    path = plain_path(F.col("_metadata.file_path"))
    where = r"([^/]+)/(\d+)/(\d+)\.[^/]*$"
    return reader.text(folder).select(
        F.regexp_extract(path, where, 1).alias("module"),
        F.regexp_replace(path, "/" + where, "/$1").alias("file_path"),
        F.lit(pipeline).alias("pipeline"),
        F.regexp_extract(path, where, 2).cast("long").alias("generation"),
        F.regexp_extract(path, where, 3).cast("long").alias("segment"),
        F.col("_metadata.file_modification_time").cast("timestamp").alias("arrived"),
        F.make_valid_utf8("value").alias("text"))


def table_segments(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of a landing table of segments."""
    reader = spark.readStream.schema(SEGMENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def findings_of(numbered: DataFrame, rule_sets: list[RuleSet], prefix: int = 0, suffix: int = 0, limit: int = 20,
                compat_prefix: bool = False) -> DataFrame:
    """Findings of numbered segments; lines after a match come from its own segment only."""
    bodies = numbered.where("fresh").withColumn("body", split_lines(F.col("text")))
    return find_in_texts(bodies, rule_sets, prefix, suffix, limit, compat_prefix=compat_prefix)


def following(
    rule_sets: list[RuleSet], places: str, action, prefix: int = 0, suffix: int = 0, limit: int = 20, started: Column | None = None,
    seeds: DataFrame | None = None, forget: str | None = None,
):
    """What a stream of segments does with each batch: number it, find, and hand the findings to `action` (findings, id).

    Places of the logs are kept in the folder `places` (see `places.Places`); they are written after the action, so a
    batch that failed runs again from the same places.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = Places(batch.sparkSession, places, prefix, forget)
        numbered = kept.number(batch, batch_id, rule_sets, started, seeds, hits_only=True)
        action(findings_of(numbered, rule_sets, prefix, suffix, limit), batch_id)
        kept.keep(batch_id)

    return run


def numbering(rule_sets: list[RuleSet], places: str, action, prefix: int = 0, started: Column | None = None, forget: str | None = None):
    """The same without findings: `action` gets the numbered segments."""
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = Places(batch.sparkSession, places, prefix, forget)
        action(kept.number(batch, batch_id, rule_sets, started), batch_id)
        kept.keep(batch_id)

    return run


def watching(places: str, action, quiet_minutes: int):
    """`action` gets the silences of modules, longer than `quiet_minutes`: one row for each, in the first batch whose
    newest arrival is that much later. A module is told of again after its next segment only, also after a restart."""
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = Places(batch.sparkSession, places)
        kept.number(batch, batch_id, [RuleSet("none")], quiet_minutes=quiet_minutes)
        action(kept.alarms, batch_id)
        kept.keep(batch_id)

    return run


def as_table(output: str):
    """An action that writes the rows of each batch to a table of its own folder; a batch that runs again replaces it."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{output}/part={batch_id}")


def run_batches(stream: DataFrame, work, output: str, checkpoint: str) -> DataFrame:
    """Process what has arrived by `work` (rows, id), whose action writes `as_table`, and read back what it wrote."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.option("basePath", output).parquet(output).drop("part")


def first_sightings(findings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeated findings within the delay; the store drops the rest."""
    return findings.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(IDENTITY)


def rolling_panes(findings: DataFrame, delay: str = "1 hour", step: str = "1 hour") -> DataFrame:
    """State of rolling statistics: one pane per module and step of time, whatever the width of the windows made of it."""
    upper = F.upper("severity")
    return (
        findings.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", step).alias("pane"), "module_name")
        .agg(F.count_if(upper.isin("ERROR", "CRITICAL")).alias("errors"),
             F.count_if(upper == "WARNING").alias("warnings"),
             F.max(F.struct("created_at", "id", "severity")).alias("newest"))
    )


def rolling_stats(panes: DataFrame, steps: int = 24) -> DataFrame:
    """Errors and warnings per module in sliding windows of `steps` panes, with the severity of the newest finding, the
    higher id first. Every window that holds a finding is a row.

    A pane is read `steps` times; findings are not. The newest of a window is the newest of its panes' newest.
    """
    width = F.col("pane.end") - F.col("pane.start")
    spread = panes.select(
        "module_name", "errors", "warnings", "newest", width.alias("step"), F.col("pane.start").alias("start"),
        F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("back"))
    begins = F.col("start") - F.col("step") * F.col("back")
    return spread.groupBy(
        F.struct(begins.alias("start"), (begins + F.col("step") * steps).alias("end")).alias("window"), "module_name"
    ).agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.max("newest").alias("newest")).select(
        "window", "module_name", "errors", "warnings", F.col("newest.severity").alias("last_severity"),
        F.col("newest.created_at").alias("last_log_update"))


def deliver(module: Module, store_path: str, payload_path: str | None = None, alert_path: str | None = None):
    """Action for each batch of findings: gate, store, payloads, alerts.

    The batch is written once, so that its state is not computed again for every sink. Running a batch again stores nothing twice and overwrites the files of that batch.
    """
    def run(findings: DataFrame, batch_id: int) -> None:
        gated = stage(findings.withColumn(
            "needs_llm", needs_model(module.gate, F.col("severity_rank"), F.col("excerpt"))), f"batch-{batch_id}")
        append(conform(gated, FINDINGS), store_path, modules=[module.name])
        if payload_path:
            payloads = with_payload(gated.where("needs_llm"), module.gate)
            payloads.select("payload_name", "payload").write.mode("overwrite").parquet(
                f"{payload_path}/batch={batch_id}")
        if alert_path and module.channels:
            alert_records(gated, list(module.channels)).select("channel", "target", "body").write.mode(
                "overwrite").parquet(f"{alert_path}/batch={batch_id}")

    return run


def run_updates(stream: DataFrame, keys: list[str], output: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, write what changes in each batch, and read back the latest state of every key.

    State of windows that the watermark has passed is dropped; their last row stays in the table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/part={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = stream.sparkSession.read.parquet(output)
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("latest"))
    return latest.select(*keys, "latest.*")


def run_available(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what has arrived, write it as a table and read that back."""
    spark = stream.sparkSession
    started = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(output)
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)

"""The findings table: append without duplicates, retention, deletion, corrections.

All functions but `append` take and give DataFrames; the caller decides when to write.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logquarry.functions.patterns import java
from logquarry.functions.text import is_blank, regex_template, strip, text_lines
from logquarry.operators.ordered import along
from logquarry.schema import FINDINGS, SEVERITY_RANK, conform
from logquarry.spec import RuleSet
from logquarry.staging import path_exists, stage

IDENTITY = ["module_name", "file_path", "line_start", "line_end", "message", "severity"]


def first_of_each(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row per identity, the first in `order`. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in batch.columns if c not in IDENTITY]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return batch.groupBy(*IDENTITY).agg(kept).select(*IDENTITY, "kept.*").select(*batch.columns)


def unseen(batch: DataFrame, stored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of a batch that are neither stored yet nor repeated within the batch."""
    fresh = first_of_each(batch, order or ["finding_index"])
    return fresh.join(stored.select(*IDENTITY), IDENTITY, "left_anti")


def read(spark: SparkSession, path: str, modules: list[str] | None = None) -> DataFrame:
    """The stored findings; naming modules prunes to their partitions."""
    stored = spark.read.schema(FINDINGS).parquet(path)
    return stored.where(F.col("module_name").isin(modules)) if modules else stored


def append(batch: DataFrame, path: str, order: list[str] | None = None, modules: list[str] | None = None) -> None:
    """Add the unseen findings of a batch to the table at `path`, partitioned by module.

    Naming the modules of the batch keeps the comparison to their partitions.
    """
    spark = batch.sparkSession
    rows = conform(batch, FINDINGS)
    if path_exists(spark, path):
        stored = spark.read.schema(FINDINGS).parquet(path)
        fresh, base = unseen(rows, read(spark, path, modules), order), stored.agg(F.max("id")).first()[0]
    else:
        fresh, base = first_of_each(rows, order or ["finding_index"]), None
    numbered = densely_numbered(fresh, 0 if base is None else base + 1)
    conform(numbered, FINDINGS).write.mode("append").partitionBy("module_name").parquet(path)


def densely_numbered(rows: DataFrame, start: int) -> DataFrame:
    """Set `id` to consecutive numbers from `start` on. Rows are written with the number of their part and their place
    in it; the parts before it, one row each, say where a part begins."""
    placed = stage(rows.withColumn("id", F.monotonically_increasing_id()), "fresh-findings")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).count().select(
        "part", (F.coalesce(F.sum("count").over(before), F.lit(0)) + start).alias("first"))
    return placed.join(F.broadcast(parts), part == F.col("part")).withColumn(
        "id", F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first")


def without_all(findings: DataFrame) -> DataFrame:
    """Drop every finding."""
    return findings.limit(0)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many findings a deletion took away, as one row (n_removed)."""
    counted = before.select(F.lit(1).alias("n")).union(after.select(F.lit(-1).alias("n")))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_removed"))


def retained(findings: DataFrame, now: Column, days: int) -> DataFrame:
    """Drop findings older than `days`; zero or less keeps all."""
    if days <= 0:
        return findings
    cutoff = now - F.make_dt_interval(F.lit(days))
    return findings.where(F.coalesce(F.col("created_at") >= cutoff, F.lit(True)))


def without_modules(findings: DataFrame, modules: list[str]) -> DataFrame:
    return findings.where(~F.coalesce(F.col("module_name").isin(modules), F.lit(False)))


def without_ids(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the findings whose id is in a table of ids."""
    return findings.join(ids.select("id"), "id", "left_anti")


def text_matches(pattern: str, pipeline: str | None = None) -> Column:
    """A finding whose message or excerpt holds the pattern (case matters), optionally of one pipeline only."""
    wanted = F.coalesce(F.col("message"), F.lit("")).rlike(java(pattern)) | F.coalesce(
        text_lines(F.col("excerpt")), F.lit("")).rlike(java(pattern))
    return (F.col("pipeline_name") == pipeline) & wanted if pipeline else wanted


def without_matches(findings: DataFrame, pattern: str, pipeline: str | None = None) -> DataFrame:
    """Drop the findings a pattern matches; an invalid pattern drops nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return findings
    return findings.where(~F.coalesce(text_matches(pattern, pipeline), F.lit(False)))


def matches_preview(findings: DataFrame, rules: RuleSet, pattern: str) -> tuple[RuleSet, DataFrame]:
    """What saving an ignore rule would change: the rule set with it, and the stored findings it would remove."""
    return with_ignore(rules, pattern), findings.where(text_matches(pattern, rules.name))


def with_ignore(rules: RuleSet, pattern: str) -> RuleSet:
    return rules if pattern in rules.ignores else replace(rules, ignores=(*rules.ignores, pattern))


def false_positive(findings: DataFrame, rules: RuleSet, finding_id: int, sample: str | None = None,
                   pattern: str | None = None) -> tuple[RuleSet, DataFrame]:
    """Turn one finding into an ignore rule and drop everything the rule matches in its pipeline.

    The rule is the given pattern, else a template of the sample line or the message. If it matches nothing stored,
    the finding itself is dropped. One row is read by its id; nothing else reaches the driver.
    """
    target = findings.where(F.col("id") == finding_id)
    source = F.coalesce(F.lit(sample or None), F.col("message"))
    found = target.select("pipeline_name", regex_template(source).alias("pattern")).first()
    if found is None:
        return rules, findings
    chosen = (pattern or "").strip() or found["pattern"]
    if not chosen:
        return rules, findings
    hit = findings.where(text_matches(chosen, found["pipeline_name"])).isEmpty()
    rest = findings.where(F.col("id") != finding_id) if hit else without_matches(
        findings, chosen, found["pipeline_name"])
    return with_ignore(rules, chosen), rest


def with_severity(findings: DataFrame, finding_id: int, severity: str) -> DataFrame:
    """Set the severity of one finding."""
    name = (severity or "").upper()
    if name not in SEVERITY_RANK:
        raise ValueError(f"Invalid severity: {severity}")
    return findings.withColumn("severity", F.when(F.col("id") == finding_id, name).otherwise(F.col("severity")))


def with_severities(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Set many severities from a table (id, new_severity); names outside the scale change nothing."""
    valid = changes.where(F.upper("new_severity").isin(*SEVERITY_RANK)).select("id", F.upper("new_severity").alias("n"))
    return findings.join(valid, "id", "left").withColumn("severity", F.coalesce("n", "severity")).drop("n").select(
        *findings.columns)


def next_index(findings: DataFrame) -> DataFrame:
    """Per module, the finding index that follows its largest; a module without findings starts at 1."""
    return findings.groupBy("module_name").agg(
        (F.coalesce(F.max("finding_index"), F.lit(0)) + 1).cast("long").alias("next_index"))


def manual_findings(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings made by hand from selected lines.

    requests: request_id, module_name, file_path, pipeline_name, severity, message, selected ARRAY<STRING>,
    line_numbers ARRAY<BIGINT>. Requests with an unknown severity or without a non-blank line give nothing.
    """
    picked = requests.withColumn("excerpt", F.filter("selected", lambda line: ~is_blank(line)))
    valid = picked.where(F.upper("severity").isin(*SEVERITY_RANK) & (F.size("excerpt") > 0))
    counted = along(valid, ["module_name"], "request_id", sums={"nth": F.lit(1)})
    start = F.coalesce(F.array_min("line_numbers"), F.lit(0))
    text = strip(F.coalesce("message", F.lit("")))
    rows = counted.join(next_index(stored), "module_name", "left").select(
        "module_name", F.coalesce("pipeline_name", F.lit("")).alias("pipeline_name"), "file_path",
        (F.coalesce("next_index", F.lit(1)) + F.col("nth") - 1).alias("finding_index"),
        F.upper("severity").alias("severity"),
        F.when(F.length(text) > 0, text).otherwise(F.col("excerpt")[0]).alias("message"),
        start.alias("line_start"),
        F.coalesce(F.array_max("line_numbers"), start + F.size("excerpt") - 1).alias("line_end"),
        "excerpt", F.lit(False).alias("needs_llm"), F.lit(False).alias("anomaly_flag"))
    return conform(rows, FINDINGS)


def merge_model_results(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Write model answers into findings by id: an answer clears the error, an error clears the answer.

    results: id, provider, model, content, error, prompt_tokens, completion_tokens; one row per id.
    """
    columns = ["provider", "model", "content", "error", "prompt_tokens", "completion_tokens"]
    incoming = results.select("id", F.struct(*columns).alias("r"))
    failed = F.col("r.error").isNotNull()

    def merged(name: str, value: Column) -> Column:
        return F.when(F.col("r").isNotNull(), value).otherwise(F.col(name)).alias(name)

    changes = {
        "llm_provider": F.col("r.provider"),
        "llm_model": F.col("r.model"),
        "llm_response_content": F.when(~failed, F.col("r.content")),
        "llm_error": F.col("r.error"),
        "llm_prompt_tokens": F.when(~failed, F.col("r.prompt_tokens")),
        "llm_completion_tokens": F.when(~failed, F.col("r.completion_tokens")),
    }
    joined = findings.join(incoming, "id", "left")
    return joined.select(*[merged(c, changes[c]) if c in changes else F.col(c) for c in findings.columns])

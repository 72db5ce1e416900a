"""Statistics of findings, freshness of logs, notifications, and ordered listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_STALE_MINUTES = 60
KEPT_NOTIFICATIONS = 200


def module_stats(findings: DataFrame, activity: DataFrame | None, now: Column) -> DataFrame:
    """Per module: errors and warnings of the last day, last severity, last update.

    activity (module_name, mtime) adds modules without findings and the time their log changed last.
    """
    upper = F.upper("severity")
    recent = findings.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(1))).groupBy("module_name").agg(
        F.count_if(upper.isin("ERROR", "CRITICAL")).alias("errors_24h"),
        F.count_if(upper == "WARNING").alias("warnings_24h"),
        F.max_by("severity", F.struct("created_at", "id")).alias("last_severity"),
        F.max("created_at").alias("last_seen"))
    if activity is None:
        return recent.withColumnRenamed("last_seen", "last_log_update")
    return recent.join(activity, "module_name", "full_outer").select(
        "module_name",
        F.coalesce("errors_24h", F.lit(0)).alias("errors_24h"),
        F.coalesce("warnings_24h", F.lit(0)).alias("warnings_24h"),
        "last_severity",
        F.greatest("last_seen", "mtime").alias("last_log_update"))


def count_findings(findings: DataFrame, severities: list[str] | None = None) -> DataFrame:
    """Findings per module, of the given severities in any case, or of all."""
    wanted = [s.upper() for s in severities or [] if s]
    rows = findings.where(F.upper("severity").isin(wanted)) if wanted else findings
    return rows.groupBy("module_name").agg(F.count("*").alias("n_findings"))


def latest_time(findings: DataFrame) -> DataFrame:
    return findings.agg(F.max("created_at").alias("latest"))


def stale_modules(modules: DataFrame, activity: DataFrame, now: Column,
                  default_minutes: int = DEFAULT_STALE_MINUTES) -> DataFrame:
    """Enabled follow modules with their window and whether their log is missing or older than it."""
    watched = modules.where(F.col("enabled") & (F.col("mode") != "batch")).select(
        F.col("name").alias("module_name"),
        F.when(F.col("stale_after_minutes") > 0, F.col("stale_after_minutes")).otherwise(default_minutes)
        .alias("window_minutes"))
    age = F.unix_micros(now) - F.unix_micros("mtime")
    return watched.join(activity, "module_name", "left").withColumn(
        "stale", F.col("mtime").isNull() | (age > F.col("window_minutes") * 60_000_000))


def freshness(modules: DataFrame, activity: DataFrame, now: Column,
              default_minutes: int = DEFAULT_STALE_MINUTES) -> DataFrame:
    """One row: state, message, number of watched and stale modules, latest update. Names are in `stale_modules`."""
    counted = stale_modules(modules, activity, now, default_minutes).agg(
        F.count("*").alias("n_watched"), F.count_if("stale").alias("n_stale"), F.max("mtime").alias("latest_log_update"),
        F.min("window_minutes").alias("least"), F.max("window_minutes").alias("most"))
    hint = F.when(F.col("least") == F.col("most"), F.concat(F.col("least").cast("string"), F.lit("m"))).otherwise(
        "their configured windows")
    none, silent = F.col("n_watched") == 0, F.col("latest_log_update").isNull()
    fresh, dead = F.col("n_stale") == 0, F.col("n_stale") == F.col("n_watched")
    return counted.select(
        F.when(none, "ok").when(silent, "error").when(fresh, "ok").when(dead, "error").otherwise("warn").alias("state"),
        F.when(none, "Staleness tracking skipped for batch modules")
        .when(silent, "No log file activity detected")
        .when(fresh, F.concat(F.lit("Logs updating (within "), hint, F.lit(")")))
        .when(dead, F.concat(F.lit("No recent log updates (> "), hint, F.lit(")")))
        .otherwise(F.concat(F.lit("Some modules stale (> "), hint, F.lit(")"))).alias("message"),
        "n_watched", "n_stale", "latest_log_update")


def newest_notifications(notifications: DataFrame, tie: str = "id") -> DataFrame:
    return notifications.orderBy(F.desc("created_at"), F.desc(tie)).limit(KEPT_NOTIFICATIONS)


def notification_summary(notifications: DataFrame, tie: str = "id") -> DataFrame:
    """One row: state, message with the latest title, and count, over the newest notifications."""
    kept = newest_notifications(notifications, tie).agg(
        F.count("*").alias("n"), F.bool_or(F.col("level") == "error").alias("has_error"),
        F.bool_or(F.col("level") == "warning").alias("has_warning"),
        F.max_by("title", F.struct("created_at", tie)).alias("title"))
    return kept.select(
        F.when(F.col("has_error"), "error").when(F.col("has_warning"), "warn").otherwise("ok").alias("state"),
        F.when(F.col("n") == 0, F.lit("All systems operational"))
        .when(F.col("has_error"), F.concat(F.lit("Attention needed: "), "title"))
        .when(F.col("has_warning"), F.concat(F.lit("Warnings present: "), "title"))
        .otherwise(F.concat(F.lit("Info: "), "title")).alias("message"),
        F.col("n").alias("n_notifications"))


def recent_findings(findings: DataFrame, limit: int | None = 50) -> DataFrame:
    """The newest findings of every module, all of them without a limit. It is applied per task before rows meet."""
    if limit is None:
        return findings
    newest = Window.partitionBy("module_name").orderBy(F.desc("created_at"), F.desc("id"))
    return findings.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit)


def recent_of_module(findings: DataFrame, module: str, limit: int = 50) -> DataFrame:
    return findings.where(F.col("module_name") == module).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_id(findings: DataFrame, finding_id: int) -> DataFrame:
    return findings.where(F.col("id") == finding_id)


def ordered_modules(modules: DataFrame) -> DataFrame:
    return modules.orderBy(F.desc("enabled"), F.lower("name"), "name")


def modules_to_run(modules: DataFrame, selected: str | None = None) -> DataFrame:
    """The named module, enabled or not; without a name the enabled follow modules."""
    if selected:
        return modules.where(F.col("name") == selected)
    return modules.where(F.col("enabled") & (F.col("mode") == "follow"))

"""Queries that run a stream over the given tables, delivered in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.text import text_lines
from logquarry.operators import store
from logquarry.plans.log_queries import LICENSE_FINDINGS, LICENSES, context_sql
from logquarry.plans.registry import FOUND, LOGS, query
from logquarry.sources.tables import document_bodies, event_findings
from logquarry.staging import new_folder, stage
from logquarry.streaming import follow

PIECES = 4


def land_documents(spark, folder):
    """Every document as a log that arrives in four segments, one delivery after the other; all logs share a module.

    Every fifth log is written anew before each segment: it has four generations of one segment.
    """
    bodies = document_bodies(spark, folder)
    size = F.greatest(F.lit(1), F.ceil(F.size("body") / PIECES).cast("int"))
    segment = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.struct(
        i.cast("long").alias("segment"), F.slice("body", i * size + 1, size).alias("part")))
    rows = unfold(bodies, ["doc_id", "file_path", "pipeline", "mtime"], segment, "s").where(F.size("s.part") > 0)
    segments = rows.select(
        F.lit("m").alias("module"), "file_path", "pipeline",
        F.when(F.col("doc_id") % 5 == 0, F.col("s.segment")).otherwise(0).cast("long").alias("generation"),
        "s.segment", F.col("mtime").alias("arrived"), F.array_join("s.part", "\n").alias("text"))
    return follow.table_segments(spark, *landed(segments, F.col("segment"), PIECES))


def landed(rows, piece, pieces, files=None):
    """A landing folder that the pieces came to one after the other, and the files of an average piece. With `files` every
    piece has that many, so that each is one delivery."""
    landing = new_folder(rows.sparkSession, "landing")
    # Written once, so that the pieces are not each cut out of all texts.
    cut = stage(rows.withColumn("__piece", piece), "pieces")
    for i in range(pieces):
        part = cut.where(F.col("__piece") == i).drop("__piece")
        (part.repartition(files) if files else part).write.mode("append").parquet(landing)
    return landing, files or max(1, len(rows.sparkSession.read.parquet(landing).inputFiles()) // pieces)


def by_batches(spark, stream, batches):
    """The rows that `batches` (places, action) gives for the stream."""
    output = new_folder(spark, "stream")
    work = batches(new_folder(spark, "places"), follow.as_table(output))
    return follow.run_batches(stream, work, output, new_folder(spark, "stream-checkpoint"))


# Line numbers of a further generation start again.
AGAIN = """sized AS (SELECT file_path, doc_id, max(line_no) AS n, greatest(1, CAST(ceil(max(line_no) / 4) AS BIGINT)) AS size FROM lines GROUP BY 1, 2)"""
TURNED = "CASE WHEN sized.doc_id % 5 = 0 THEN (line_start - 1) % size + 1 ELSE line_start END"


@query("stream_findings", f"""WITH {LICENSE_FINDINGS}, {AGAIN}
SELECT file_path, severity, message, {TURNED} AS line_start, rule_id, true AS distinct_index
FROM findings JOIN sized USING (file_path)""")
def stream_findings(spark, folder):
    rows = by_batches(spark, land_documents(spark, folder), lambda places, action: follow.following([LICENSES], places, action))
    # Finding numbers of a module go on from log to log: each is given once.
    again = rows.groupBy("module_name", "finding_index").agg(F.count(F.lit(1)).alias("given"))
    return rows.join(again, ["module_name", "finding_index"]).select(
        "file_path", "severity", "message", "line_start", "rule_id", (F.col("given") == 1).alias("distinct_index"))


@query("stream_carried_context", f"""WITH {LICENSE_FINDINGS}, {AGAIN}, {context_sql(2, 0)}
SELECT f.file_path, {TURNED} AS line_start, f.rule_id, f.message, excerpt
FROM findings f JOIN sized USING (file_path) JOIN context c ON c.file_path = f.file_path AND c.line_no = f.line_start""")
def stream_carried_context(spark, folder):
    found = by_batches(spark, land_documents(spark, folder), lambda places, action: follow.following([LICENSES], places, action, prefix=2))
    return found.select("file_path", "line_start", "rule_id", "message", text_lines(F.col("excerpt")).alias("excerpt"))


@query("stream_numbering", f"""WITH {LOGS}, {AGAIN},
pieces AS (SELECT file_path, doc_id, n, unnest([0, 1, 2, 3]) AS segment, size FROM sized)
SELECT file_path, CAST(segment AS BIGINT) AS segment, CAST(CASE WHEN doc_id % 5 = 0 THEN 1
  ELSE segment * size + 1 END AS BIGINT) AS start_line FROM pieces WHERE segment * size < n""")
def stream_numbering(spark, folder):
    # The batches write what is asked of a segment, not its text again.
    numbered = by_batches(spark, land_documents(spark, folder), lambda places, action: follow.numbering(
        [LICENSES], places, lambda rows, batch_id: action(rows.select("file_path", "segment", "start_line"), batch_id)))
    return numbered.select("file_path", "segment", "start_line")


@query("stream_silences", f"""WITH {LOGS}, arrived AS (SELECT DISTINCT concat('m', doc_id % 7) AS module, mtime FROM lines),
gaps AS (SELECT module, mtime, coalesce(lead(mtime) OVER (PARTITION BY module ORDER BY mtime), (SELECT max(mtime) FROM arrived)) AS until FROM arrived)
SELECT module, mtime AS silent_since, mtime + 300 AS alarm_at FROM gaps WHERE until - mtime > 300""")
def stream_silences(spark, folder):
    """Logs of seven modules arrive in the order of their times, in five deliveries."""
    rows = document_bodies(spark, folder).where(F.size("body") > 0).select(
        F.concat(F.lit("m"), F.col("doc_id") % 7).alias("module"), "file_path", "pipeline", F.lit(0).cast("long").alias("generation"),
        F.lit(0).cast("long").alias("segment"), F.col("mtime").alias("arrived"), F.array_join("body", "\n").alias("text"))
    span = rows.agg(F.min("arrived").alias("first"), F.max("arrived").alias("last")).first()
    width = (span["last"] - span["first"]).total_seconds() / 5 + 1 if span["first"] else 1
    piece = F.floor((F.unix_timestamp("arrived") - F.unix_timestamp(F.lit(span["first"]).cast("timestamp"))) / width)
    stream = follow.table_segments(spark, *landed(rows, piece, 5, files=4))
    told = by_batches(spark, stream, lambda places, action: follow.watching(places, action, 5))
    return told.select("module", *[F.unix_timestamp(c).alias(c) for c in ("silent_since", "alarm_at")])


def landed_events(spark, folder):
    """Findings that arrive in four pieces, in the order of their times."""
    rows = event_findings(spark, folder)
    span = rows.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last")).first()
    width = (span["last"] - span["first"]).total_seconds() / 4 + 1 if span["first"] else 1
    start = F.unix_timestamp(F.lit(span["first"]).cast("timestamp"))
    landing, files = landed(rows, F.floor((F.unix_timestamp("created_at") - start) / width), 4)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(files)).parquet(landing)


@query("stream_stats", f"""WITH {FOUND}, starts AS (SELECT s.*, date_trunc('hour', created_at) - (INTERVAL 1 HOUR) * h AS begins
  FROM stored s, range(0, 24) t(h))
SELECT module_name, epoch_us(begins) AS begins, count(*) FILTER (upper(severity) IN ('ERROR', 'CRITICAL')) AS errors,
  count(*) FILTER (upper(severity) = 'WARNING') AS warnings, epoch_us(max(created_at)) AS last_log_update,
  last(severity ORDER BY created_at, id) AS last_severity
FROM starts GROUP BY 1, 2""")
def stream_stats(spark, folder):
    panes = follow.rolling_panes(landed_events(spark, folder))
    kept = follow.run_updates(panes, ["module_name", "pane"], new_folder(spark, "stream"), new_folder(spark, "stream-checkpoint"))
    return follow.rolling_stats(kept).select(
        "module_name", F.unix_micros("window.start").alias("begins"), "errors", "warnings",
        F.unix_micros("last_log_update").alias("last_log_update"), "last_severity")


@query("stream_dedupe", f"""WITH {FOUND} SELECT module_name, file_path, line_start, message, severity, count(*) > 0 AS kept
FROM stored GROUP BY 1, 2, 3, 4, 5""")
def stream_dedupe(spark, folder):
    """Repeats within an hour are dropped from the stream, later ones by the store that each batch is added to."""
    kept = follow.first_sightings(landed_events(spark, folder), delay="1 hour")
    path = new_folder(spark, "store")
    (kept.writeStream.foreachBatch(lambda batch, _: store.append(batch, path)).trigger(availableNow=True)
     .option("checkpointLocation", new_folder(spark, "stream-checkpoint")).start().awaitTermination())
    return store.read(spark, path).select(
        "module_name", "file_path", "line_start", "message", "severity", F.lit(True).alias("kept"))

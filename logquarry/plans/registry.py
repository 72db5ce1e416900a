"""Named queries with, where it exists, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# SQL views shared by the questions below.
LOGS = """
logs AS (SELECT doc_id, concat(source, '/', doc_id, '.log') AS file_path, source AS module, lang AS pipeline,
                1704067200 + doc_id * 60 AS mtime, text FROM documents),
lines AS (SELECT file_path, module, pipeline, mtime, doc_id, u.line AS line, u.line_no AS line_no FROM (
            SELECT *, unnest(list_zip(string_split(text, chr(10)),
                                      range(1, len(string_split(text, chr(10))) + 1))) AS z FROM logs) t,
          LATERAL (SELECT z[1] AS line, z[2] AS line_no) u)
"""

FOUND = """
stored AS (SELECT event_id AS id, concat('m', user_id % 10) AS module_name, concat('p', user_id % 3) AS pipeline_name,
  concat('/var/log/u', user_id, '.log') AS file_path, event_id AS finding_index,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'CRITICAL'
                  WHEN 'click' THEN 'warning' ELSE 'INFO' END AS severity,
  concat(event_type, ' ', props) AS message, CAST(floor(value) AS BIGINT) AS line_start,
  CAST(floor(value) AS BIGINT) AS line_end, event_type AS rule_id, [props, concat('type=', event_type)] AS excerpt,
  ts AS created_at FROM events)
"""

"""Queries on stored findings: maintenance, statistics, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import stats, store
from logquarry.plans.registry import FOUND, query
from logquarry.sources.tables import event_findings, table
from logquarry.spec import RuleSet
from logquarry.staging import new_folder

NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def now():
    return F.expr(NOW)


def micros(column: str):
    return F.unix_micros(column).alias(column)


@query("store_dedupe", f"""WITH {FOUND}, old AS (SELECT * FROM stored WHERE created_at < TIMESTAMP '2024-01-10'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY module_name, file_path, line_start, line_end, message, severity
  ORDER BY finding_index) AS n FROM stored)
SELECT module_name, file_path, line_start, message, severity, finding_index FROM firsts f WHERE n = 1 AND NOT EXISTS (
  SELECT 1 FROM old o WHERE o.module_name = f.module_name AND o.file_path = f.file_path AND o.line_start = f.line_start
  AND o.line_end = f.line_end AND o.message = f.message AND o.severity = f.severity)""")
def store_dedupe(spark, folder):
    batch = event_findings(spark, folder)
    stored = batch.where("created_at < TIMESTAMP '2024-01-10'")
    return store.unseen(batch, stored).select(
        "module_name", "file_path", "line_start", "message", "severity", "finding_index")


@query("store_append", f"""WITH {FOUND}, firsts AS (SELECT DISTINCT module_name, file_path, line_start, line_end, message,
  severity FROM stored) SELECT module_name, count(*) AS n_findings, (SELECT count(*) FROM firsts) AS n_ids,
  0 AS first_id, (SELECT count(*) - 1 FROM firsts) AS last_id FROM firsts GROUP BY 1""")
def store_append(spark, folder):
    """Two overlapping batches are added to a table and read back: no finding twice, ids without a gap."""
    rows = event_findings(spark, folder)
    path = new_folder(spark, "store")
    store.append(rows.where("created_at < TIMESTAMP '2024-01-20'"), path)
    store.append(rows.where("created_at >= TIMESTAMP '2024-01-10'"), path)
    stored = store.read(spark, path)
    ids = stored.agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return stored.groupBy("module_name").agg(F.count("*").alias("n_findings")).select(
        "module_name", "n_findings", *[ids.select(c).scalar().alias(c) for c in ids.columns])


@query("delete_all", f"WITH {FOUND} SELECT CAST(count(*) AS BIGINT) AS n_removed FROM stored")
def delete_all(spark, folder):
    rows = event_findings(spark, folder)
    return store.removed(rows, store.without_all(rows))


@query("batch_dedupe", f"""WITH {FOUND} SELECT module_name, severity, rule_id, min(finding_index) AS finding_index,
 count(*) AS copies FROM (SELECT module_name, severity, rule_id, finding_index, file_path FROM stored) GROUP BY 1, 2, 3""")
def batch_dedupe(spark, folder):
    """Coarse identities, so that each has many copies."""
    rows = event_findings(spark, folder)
    coarse = rows.withColumns({"file_path": F.lit("f"), "line_start": F.lit(1), "line_end": F.lit(1),
                               "message": F.col("rule_id")})
    kept = store.first_of_each(coarse, ["finding_index"])
    copies = rows.groupBy("module_name", "severity", "rule_id").agg(F.count("*").alias("copies"))
    return kept.select("module_name", "severity", "rule_id", "finding_index").join(
        copies, ["module_name", "severity", "rule_id"])


@query("retention", f"WITH {FOUND} SELECT id, module_name FROM stored WHERE created_at >= {NOW} - INTERVAL 7 DAY")
def retention(spark, folder):
    return store.retained(event_findings(spark, folder), now(), 7).select("id", "module_name")


@query("delete_module", f"WITH {FOUND} SELECT id, module_name FROM stored WHERE module_name NOT IN ('m3', 'm7')")
def delete_module(spark, folder):
    return store.without_modules(event_findings(spark, folder), ["m3", "m7"]).select("id", "module_name")


@query("delete_ids", f"WITH {FOUND} SELECT id, severity FROM stored WHERE id NOT IN (SELECT doc_id FROM labels)")
def delete_ids(spark, folder):
    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return store.without_ids(event_findings(spark, folder), ids).select("id", "severity")


@query("delete_regex", f"""WITH {FOUND} SELECT id, message FROM stored WHERE NOT (pipeline_name = 'p1' AND
  (regexp_matches(message, 'r .*: 1\\d\\D') OR regexp_matches(array_to_string(excerpt, chr(10)), '(?:"k": 5|type=view)')))""")
def delete_regex(spark, folder):
    rows = event_findings(spark, folder)
    rows = store.without_matches(rows, r"r .*: 1\d\D", "p1")
    return store.without_matches(rows, r'(?:"k": 5|type=view)', "p1").select("id", "message")


TEMPLATE = (r"regexp_replace(regexp_replace(regexp_replace({0}, "
            r"'([\t\n\x0B\f\r #$&()*+\-.?\[\\\]^{{|}}~])', '\\\1', 'g'), '\d+', '\\d+', 'g'), "
            r"'[A-Fa-f0-9]{{6,}}', '[A-Fa-f0-9]+', 'g')")


@query("false_positive", f"""WITH {FOUND}, target AS (SELECT pipeline_name AS p, {TEMPLATE.format('message')} AS pattern
  FROM stored WHERE id = 42)
SELECT id, message, pattern AS ignore_rule FROM stored, target WHERE NOT (pipeline_name = p AND
  (regexp_matches(message, pattern) OR regexp_matches(array_to_string(excerpt, chr(10)), pattern)))""")
def false_positive(spark, folder):
    rules, rest = store.false_positive(event_findings(spark, folder), RuleSet("p"), 42)
    return rest.select("id", "message", F.lit(rules.ignores[-1]).alias("ignore_rule"))


@query("ignore_preview", f"""WITH {FOUND} SELECT id, severity FROM stored WHERE pipeline_name = 'p2' AND
  (regexp_matches(message, '"k": 7\\d?') OR regexp_matches(array_to_string(excerpt, chr(10)), '"k": 7\\d?'))""")
def ignore_preview(spark, folder):
    _, removed = store.matches_preview(event_findings(spark, folder), RuleSet("p2"), r'"k": 7\d?')
    return removed.select("id", "severity")


@query("set_severity", f"""WITH {FOUND} SELECT id, CASE WHEN id = 17 THEN 'CRITICAL' ELSE severity END AS severity
FROM stored""")
def set_severity(spark, folder):
    return store.with_severity(event_findings(spark, folder), 17, "critical").select("id", "severity")


@query("set_severities", f"""WITH {FOUND} SELECT id, CASE toxic WHEN 1 THEN 'CRITICAL' WHEN 0 THEN
 CASE quality WHEN 1 THEN 'WARNING' ELSE severity END ELSE severity END AS severity
 FROM stored LEFT JOIN labels ON doc_id = id""")
def set_severities(spark, folder):
    changes = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.when(
        F.col("toxic") == 1, "critical").when(F.col("quality") == 1, "Warning").otherwise("fine").alias("new_severity"))
    return store.with_severities(event_findings(spark, folder), changes).select("id", "severity")


@query("next_index", f"""WITH {FOUND} SELECT module_name, max(finding_index) + 1 AS next_index FROM stored GROUP BY 1""")
def next_index(spark, folder):
    return store.next_index(event_findings(spark, folder))


@query("manual_finding", f"""WITH {FOUND}, nexts AS (SELECT module_name, max(finding_index) + 1 AS nx FROM stored GROUP BY 1),
req AS (SELECT doc_id AS request_id, concat('m', doc_id % 13) AS module_name, source AS file_path, lang AS pipeline_name,
  string_split(text, chr(10)) AS selected, length(text) % 5 AS kind FROM documents),
valid AS (SELECT *, row_number() OVER (PARTITION BY module_name ORDER BY request_id) AS nth FROM req WHERE kind < 4)
SELECT v.module_name, file_path, pipeline_name, CAST(coalesce(nx, 1) + nth - 1 AS BIGINT) AS finding_index,
  CASE kind WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
  CASE WHEN kind = 2 THEN 'seen by hand' ELSE selected[1] END AS message,
  CASE WHEN kind = 1 THEN 0 ELSE request_id + 5 END AS line_start,
  CAST(CASE WHEN kind = 1 THEN len(selected) - 1 ELSE request_id + 9 END AS BIGINT) AS line_end,
  CAST(len(selected) AS BIGINT) AS n_lines FROM valid v LEFT JOIN nexts n ON n.module_name = v.module_name""")
def manual_finding(spark, folder):
    kind = F.length("text") % 5
    requests = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"), F.concat(F.lit("m"), F.col("doc_id") % 13).alias("module_name"),
        F.col("source").alias("file_path"), F.col("lang").alias("pipeline_name"),
        F.when(kind == 0, "error").when(kind == 1, "WARNING").when(kind == 4, "fine").otherwise("Critical")
        .alias("severity"),
        F.when(kind == 2, " seen by hand ").alias("message"), F.split("text", "\n").alias("selected"),
        F.when(kind != 1, F.array(F.col("doc_id") + 9, F.col("doc_id") + 5)).alias("line_numbers"))
    made = store.manual_findings(requests, event_findings(spark, folder))
    return made.select("module_name", "file_path", "pipeline_name", "finding_index", "severity", "message",
                       "line_start", "line_end", F.size("excerpt").cast("long").alias("n_lines"))


@query("model_results_merge", f"""WITH {FOUND}, res AS (SELECT doc_id AS rid, quality, toxic FROM labels)
SELECT id, CASE WHEN rid IS NOT NULL THEN 'local' END AS llm_provider,
 CASE WHEN rid IS NOT NULL AND toxic = 0 THEN concat('answer ', quality) END AS llm_response_content,
 CASE WHEN toxic = 1 THEN 'timeout' END AS llm_error,
 CASE WHEN rid IS NOT NULL AND toxic = 0 THEN CAST(rid * 2 AS BIGINT) END AS llm_prompt_tokens
FROM stored LEFT JOIN res ON rid = id""")
def model_results_merge(spark, folder):
    results = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.lit("local").alias("provider"), F.lit("tiny").alias("model"),
        F.concat(F.lit("answer "), "quality").alias("content"), F.when(F.col("toxic") == 1, "timeout").alias("error"),
        (F.col("doc_id") * 2).alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"))
    return store.merge_model_results(event_findings(spark, folder), results).select(
        "id", "llm_provider", "llm_response_content", "llm_error", "llm_prompt_tokens")


def nation_activity(spark, folder):
    """Modules are nations; the log of each was last written with its latest event before it fell silent."""
    events = table(spark, folder, "events")
    seen = events.where("user_id % 25 <> 4").groupBy((F.col("user_id") % 25).cast("int").alias("k")).agg(
        F.max(F.when(F.col("value") > 40 + F.col("user_id") % 25 * 10, F.col("ts").cast("timestamp"))).alias("mtime"))
    return table(spark, folder, "nation").join(seen, F.col("n_nationkey") == F.col("k"), "left").select(
        F.col("n_name").alias("module_name"), "mtime")


ACTIVITY = """activity AS (SELECT n_name AS module_name, mtime FROM nation LEFT JOIN (SELECT user_id % 25 AS k,
  max(CASE WHEN value > 40 + user_id % 25 * 10 THEN ts END) AS mtime FROM events WHERE user_id % 25 <> 4 GROUP BY 1)
  ON k = n_nationkey)"""


@query("module_stats", f"""WITH {FOUND}, {ACTIVITY}, named AS (SELECT *, concat('NATION_', CAST(substr(module_name, 2) AS
  INT) * 3) AS m FROM stored WHERE created_at >= {NOW} - INTERVAL 1 DAY),
agg AS (SELECT m, count(*) FILTER (upper(severity) IN ('ERROR', 'CRITICAL')) AS errors_24h,
  count(*) FILTER (upper(severity) = 'WARNING') AS warnings_24h, arg_max(severity, id) AS last_severity,
  max(created_at) AS seen FROM named GROUP BY 1)
SELECT coalesce(m, module_name) AS module_name, coalesce(errors_24h, 0) AS errors_24h,
  coalesce(warnings_24h, 0) AS warnings_24h, last_severity, epoch_us(greatest(seen, mtime)) AS last_log_update
FROM agg FULL JOIN activity ON m = module_name""")
def module_stats(spark, folder):
    found = event_findings(spark, folder).withColumn(
        "module_name", F.concat(F.lit("NATION_"), F.substring("module_name", 2, 9).cast("int") * 3))
    return stats.module_stats(found, nation_activity(spark, folder), now()).withColumn(
        "last_log_update", F.unix_micros("last_log_update"))


@query("count_findings", f"""WITH {FOUND} SELECT module_name, count(*) AS n_findings FROM stored
WHERE upper(severity) IN ('ERROR', 'WARNING') GROUP BY 1""")
def count_findings(spark, folder):
    return stats.count_findings(event_findings(spark, folder), ["error", "Warning"])


@query("latest_time", f"WITH {FOUND} SELECT epoch_us(max(created_at)) AS latest FROM stored")
def latest_time(spark, folder):
    return stats.latest_time(event_findings(spark, folder)).select(micros("latest"))


def nation_watch(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") % 6 != 5).alias("enabled"),
        F.when(F.col("n_nationkey") % 4 == 3, "batch").otherwise("follow").alias("mode"),
        F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") * 600 + 100).cast("long").alias("stale_after_minutes"))


WATCHED = f"""{ACTIVITY}, watched AS (SELECT n_name AS module_name, CASE WHEN n_nationkey % 3 = 0
   THEN n_nationkey * 600 + 100 ELSE 60 END AS win FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 4 <> 3),
judged AS (SELECT w.*, mtime, mtime IS NULL OR epoch_us({NOW}) - epoch_us(mtime) > win * CAST(60000000 AS BIGINT) AS stale
   FROM watched w LEFT JOIN activity USING (module_name))"""


@query("freshness", f"""WITH {WATCHED}, a AS (SELECT count(*) AS n_watched, count(*) FILTER (stale) AS n_stale,
  max(mtime) AS latest FROM judged)
SELECT n_watched, n_stale, epoch_us(latest) AS latest_log_update, CASE WHEN latest IS NULL THEN 'error' WHEN n_stale = 0
 THEN 'ok' WHEN n_stale = n_watched THEN 'error' ELSE 'warn' END AS state, CASE WHEN latest IS NULL
 THEN 'No log file activity detected' WHEN n_stale = 0 THEN 'Logs updating (within their configured windows)'
 WHEN n_stale = n_watched THEN 'No recent log updates (> their configured windows)'
 ELSE 'Some modules stale (> their configured windows)' END AS message FROM a""")
def freshness(spark, folder):
    return stats.freshness(nation_watch(spark, folder), nation_activity(spark, folder), now()).withColumn(
        "latest_log_update", F.unix_micros("latest_log_update"))


@query("stale_modules", f"WITH {WATCHED} SELECT module_name, CAST(win AS BIGINT) AS window_minutes, stale FROM judged")
def stale_modules(spark, folder):
    return stats.stale_modules(nation_watch(spark, folder), nation_activity(spark, folder), now()).select(
        "module_name", F.col("window_minutes").cast("long").alias("window_minutes"), "stale")


def event_notifications(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "error").when(
            F.col("event_type") == "purchase", "warning").otherwise("info").alias("level"),
        F.concat("event_type", F.lit(" of "), "user_id").alias("title"), F.col("props").alias("detail"),
        F.col("ts").cast("timestamp").alias("created_at"))


NOTES = """notes AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning'
  ELSE 'info' END AS level, concat(event_type, ' of ', user_id) AS title, ts FROM events ORDER BY ts DESC, event_id DESC
  LIMIT 200)"""


@query("newest_notifications", f"WITH {NOTES} SELECT id, level, title FROM notes")
def newest_notifications(spark, folder):
    return stats.newest_notifications(event_notifications(spark, folder)).select("id", "level", "title")


@query("notification_summary", f"""WITH {NOTES}, a AS (SELECT bool_or(level = 'error') AS e, bool_or(level = 'warning') AS w,
  arg_max(title, id) AS t, count(*) AS n FROM notes)
SELECT CASE WHEN e THEN 'error' WHEN w THEN 'warn' ELSE 'ok' END AS state, CASE WHEN e THEN concat('Attention needed: ', t)
  WHEN w THEN concat('Warnings present: ', t) ELSE concat('Info: ', t) END AS message, n AS n_notifications FROM a""")
def notification_summary(spark, folder):
    return stats.notification_summary(event_notifications(spark, folder))


@query("recent_findings", f"""WITH {FOUND} SELECT module_name, id, nth FROM (SELECT *, row_number() OVER (
  PARTITION BY module_name ORDER BY created_at DESC, id DESC) AS nth FROM stored) WHERE nth <= 50""")
def recent_findings(spark, folder):
    return stats.recent_findings(event_findings(spark, folder)).select(
        "module_name", "id", F.col("nth").cast("long").alias("nth"))


@query("point_lookup", f"WITH {FOUND} SELECT id, message, severity FROM stored WHERE id = 123")
def point_lookup(spark, folder):
    return stats.by_id(event_findings(spark, folder), 123).select("id", "message", "severity")


@query("module_order", """SELECT n_name AS name, n_nationkey % 6 <> 5 AS enabled FROM nation
ORDER BY enabled DESC, lower(n_name), n_name""")
def module_order(spark, folder):
    return stats.ordered_modules(nation_watch(spark, folder)).select("name", "enabled")


@query("modules_to_run", """SELECT n_name AS name FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 4 <> 3""")
def modules_to_run(spark, folder):
    return stats.modules_to_run(nation_watch(spark, folder)).select("name")

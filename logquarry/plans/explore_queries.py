"""Queries of the log explorer and of the rule workbench."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import explore, line_store
from logquarry.operators.rules import PRESET_RULES
from logquarry.plans.log_queries import LICENSE_FINDINGS, LICENSES, license_findings, lines
from logquarry.plans.registry import FOUND, LOGS, query
from logquarry.plans.store_queries import TEMPLATE
from logquarry.sources.tables import event_findings
from logquarry.staging import new_folder

PAGE = """shown AS (SELECT l.*, total FROM lines l JOIN (SELECT file_path, max(line_no) AS total FROM lines GROUP BY 1) t
  USING (file_path) WHERE line_no > total - 1 - 3 AND line_no <= total - 1)"""


@query("log_page", f"""WITH {LOGS}, {PAGE} SELECT file_path, line_no, substr(line, 1, 60) AS line,
  greatest(0, total - 4) + 1 AS start_line, total AS total_lines, greatest(0, total - 4) > 0 AS has_more,
  1 + (total - 1) - greatest(0, total - 4) AS next_offset FROM shown""")
def log_page(spark, folder):
    return explore.page(lines(spark, folder), limit=3, offset=1, max_chars=60).drop("module")


@query("log_page_stored", f"""WITH {LOGS}, {PAGE} SELECT file_path, module, line_no, substr(line, 1, 60) AS line,
  greatest(0, total - 4) + 1 AS start_line, total AS total_lines, greatest(0, total - 4) > 0 AS has_more,
  1 + (total - 1) - greatest(0, total - 4) AS next_offset FROM shown WHERE file_path = (
    SELECT file_path FROM lines GROUP BY 1 ORDER BY max(line_no) DESC, file_path LIMIT 1)""")
def log_page_stored(spark, folder):
    store = line_store.store_lines(lines(spark, folder), new_folder(spark, "line-store"))
    return line_store.stored_page(spark, store, line_store.longest_log(spark, store), limit=3, offset=1, max_chars=60)


VIEW = f"""{LICENSE_FINDINGS}, {PAGE},
numbered AS (SELECT *, doc_id * 4294967296 + finding_index AS id FROM findings),
newest AS (SELECT file_path, line_start AS line_no, max(id) AS id, arg_max(severity, id) AS severity,
  arg_max(message, id) AS message FROM numbered GROUP BY 1, 2),
view_ AS (SELECT coalesce(s.file_path, n.file_path) AS file_path, coalesce(s.line_no, n.line_no) AS line_no,
  coalesce(substr(s.line, 1, 4000), l.line) AS text, s.line_no IS NOT NULL AS on_page, id, severity, message
  FROM shown s FULL JOIN newest n ON n.file_path = s.file_path AND n.line_no = s.line_no
  LEFT JOIN lines l ON l.file_path = n.file_path AND l.line_no = n.line_no)"""


def view(spark, folder):
    text = lines(spark, folder)
    doc = F.regexp_extract("file_path", r"/(\d+)\.log$", 1).cast("long")
    found = license_findings(spark, folder).withColumns(
        {"module_name": F.col("file_path"), "id": doc * (1 << 32) + F.col("finding_index")})
    shown = explore.page(text, limit=3, offset=1)
    return explore.log_view(shown, found, text, list(LICENSES.errors + LICENSES.warnings))


@query("log_view", f"WITH {VIEW} SELECT file_path, line_no, text, on_page, id, severity, message FROM view_")
def log_view(spark, folder):
    return view(spark, folder).select("file_path", "line_no", "text", "on_page", "id", "severity", "message")


@query("view_filter", f"WITH {VIEW} SELECT file_path, line_no, id FROM view_ WHERE severity = 'ERROR'")
def view_filter(spark, folder):
    return explore.filter_view(view(spark, folder), "error").select("file_path", "line_no", "id")


@query("view_active", f"WITH {VIEW} SELECT file_path, line_no, id FROM view_")
def view_active(spark, folder):
    return explore.filter_view(view(spark, folder), "ALL", active_only=True).select("file_path", "line_no", "id")


@query("severity_facet", f"""WITH {VIEW} SELECT file_path, severity, min(line_no) AS first_line FROM view_
WHERE severity IS NOT NULL GROUP BY 1, 2""")
def severity_facet(spark, folder):
    return explore.severity_facet(view(spark, folder))


@query("displayed_findings", f"""WITH {VIEW} SELECT file_path, count(DISTINCT id) AS n_findings FROM view_
WHERE id IS NOT NULL GROUP BY 1""")
def displayed_findings(spark, folder):
    return explore.displayed_findings(view(spark, folder))


@query("line_examples", f"WITH {VIEW} SELECT id, text AS example FROM view_ WHERE id IS NOT NULL AND text <> ''")
def line_examples(spark, folder):
    return explore.line_examples(view(spark, folder))


ERROR_LINES = f"""{FOUND}, recent AS (SELECT *, row_number() OVER (PARTITION BY module_name ORDER BY created_at DESC, id DESC)
   AS nth FROM stored),
listing AS (SELECT module_name, nth, unnest([concat('[', severity, '] finding #', finding_index, ' @ ',
   strftime(created_at, '%Y-%m-%d %H:%M:%S'), ' UTC'), excerpt[1], excerpt[2]]) AS line, unnest([0, 1, 2]) AS slot
   FROM recent WHERE nth <= 200),
listed AS (SELECT module_name, row_number() OVER (PARTITION BY module_name ORDER BY nth, slot) AS line_no, line
   FROM listing)"""


@query("error_lines", f"WITH {ERROR_LINES} SELECT * FROM listed WHERE line_no <= 200")
def error_lines(spark, folder):
    return explore.error_lines(event_findings(spark, folder))


@query("header_filter", f"""WITH {ERROR_LINES} SELECT * FROM listed WHERE line_no <= 200
  AND NOT regexp_matches(trim(line), '(?i)^\\[[A-Z]+\\]\\s+finding #\\d+\\s+@')""")
def header_filter(spark, folder):
    return explore.without_headers(explore.error_lines(event_findings(spark, folder)))


@query("sample_lines", f"""WITH {LOGS} SELECT file_path, line_no, substr(line, 1, 2000) AS "full",
  CASE WHEN length(line) > 240 THEN concat(substr(line, 1, 240), '…') ELSE line END AS preview,
  length(line) > 240 AS is_preview_truncated, length(line) > 2000 AS was_clipped FROM lines""")
def sample_lines(spark, folder):
    return explore.samples(lines(spark, folder))


@query("rule_test", f"WITH {LOGS} SELECT file_path, line_no FROM lines WHERE regexp_matches(line, 'Licensed|[0-9]{{3}}')")
def rule_test(spark, folder):
    return explore.rule_matches(lines(spark, folder), "Licensed|[0-9]{3}")


RATED = PRESET_RULES + (("Licences", "license", "error"), ("Numbers", r"\d{4}", "warning"))


@query("rule_match_rates", f"WITH {LOGS} " + " UNION ALL ".join(
    f"""SELECT '{label}' AS label, '{kind}' AS kind, count(*) FILTER (regexp_matches(line, '{pattern}')) AS n_matches,
    count(*) AS n_lines, round(count(*) FILTER (regexp_matches(line, '{pattern}')) / count(*), 9) AS rate FROM lines"""
    for label, pattern, kind in RATED))
def rule_match_rates(spark, folder):
    return explore.match_rates(lines(spark, folder), list(RATED))


@query("line_templates", f"WITH {LOGS} SELECT {TEMPLATE.format('trim(line)')} AS template, count(*) AS n_lines "
                         "FROM lines GROUP BY 1")
def line_templates(spark, folder):
    return explore.line_templates(lines(spark, folder))

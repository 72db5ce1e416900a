"""Queries on logs: numbering, grouping, rules, context."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from logquarry.functions.text import text_lines
from logquarry.operators.classify import find_by_chunk, find_in_lines, find_in_texts
from logquarry.operators.grouping import chunk_lines, chunk_table
from logquarry.operators.rules import register_chunk_classifier, route
from logquarry.plans.analyze import analyze
from logquarry.plans.registry import LOGS, query
from logquarry.sources.tables import document_bodies, document_logs, file_folder, spread, table
from logquarry.sources import sinks
from logquarry.sources.text_logs import explode_texts, scan_text
from logquarry.spec import Grouping, ModelGate, Module, RuleSet
from logquarry.staging import new_folder, plain_folder

LICENSES = RuleSet("licenses", errors=(r"licensed? under", r"license"), warnings=(r"\b[a-z]*sh\b",),
                   ignores=(r"reserved",))
BACKUPS = RuleSet("backups", classifier="rsnapshot_basic", errors=(r"license",), warnings=(r"\bthe\b",),
                  ignores=(r"reserved",), grouping=Grouping("whole_file", start=r"^The and", end=r"^Of\.$"))
BY_MARKER = RuleSet("marker", errors=(r"license",), grouping=Grouping("marker", start=r"^The ", end=r"\.$"))
BY_SEPARATOR = RuleSet("separator", errors=(r"license",), warnings=(r"\bthis\b",),
                       grouping=Grouping("separator", separator=r"^[A-D]"))
LAST_SEPARATED = RuleSet("last", errors=(r"license",), warnings=(r"\bthis\b",),
                         grouping=Grouping("separator", separator=r"^[A-D]", only_last=True))
LAST_MARKED = RuleSet("last", errors=(r"license",),
                      grouping=Grouping("marker", start=r"^The ", end=r"\.$", only_last=True))


def lines(spark, folder):
    return explode_texts(document_logs(spark, folder))


@query("scan_numbered_lines", f"""WITH {LOGS}
SELECT file_path, module, pipeline, line_no, line FROM lines""")
def scan_numbered_lines(spark, folder):
    return lines(spark, folder).select("file_path", "module", "pipeline", "line_no", "line")


# SQL for the hits of one rule set: rank, rule number, pattern as reported, pattern as searched.
def hits_sql(source: str, rules: list[tuple[str, int, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT l.*, '{sev}' AS severity, {2 if sev == 'ERROR' else 1} AS severity_rank, {idx} AS rule_idx,
        '{pattern}' AS rule_id, z[1] AS match_text, z[2] AS match_idx FROM (SELECT l.*,
        unnest(list_zip(regexp_extract_all(line, '(?i){pattern}'),
                        range(0, len(regexp_extract_all(line, '(?i){pattern}'))))) AS z FROM {source} l) l"""
        for sev, idx, pattern, _ in rules)


SNIPPET = "CASE WHEN length(match_text) > 120 THEN concat(substr(match_text, 1, 117), '...') ELSE match_text END"
ORDER = "line_no, severity_rank DESC, rule_idx, match_idx"
LICENSE_HITS = hits_sql("(SELECT * FROM lines WHERE NOT regexp_matches(line, '(?i)reserved'))", [
    ("ERROR", 0, r"licensed? under", ""), ("ERROR", 1, r"license", ""), ("WARNING", 0, r"\b[a-z]*sh\b", "")])
LICENSE_FINDINGS = f"""{LOGS}, hits AS ({LICENSE_HITS}),
findings AS (SELECT file_path, module AS module_name, pipeline AS pipeline_name, mtime, severity, severity_rank,
  line_no AS line_start, line_no AS line_end, line, rule_id, doc_id,
  concat('Matched ', lower(severity), ' pattern /', rule_id, '/ on "', {SNIPPET}, '"') AS message,
  CAST(row_number() OVER (PARTITION BY file_path ORDER BY {ORDER}) - 1 AS BIGINT) AS finding_index FROM hits)"""


def license_findings(spark, folder):
    return find_in_texts(document_bodies(spark, folder), [LICENSES])


@query("rule_findings", f"""WITH {LICENSE_FINDINGS}
SELECT file_path, module_name, pipeline_name, finding_index, severity, message, line_start, line_end, rule_id,
       line AS excerpt, CAST(mtime AS BIGINT) AS created_at FROM findings""")
def rule_findings(spark, folder):
    return license_findings(spark, folder).select(
        "file_path", "module_name", "pipeline_name", "finding_index", "severity", "message", "line_start", "line_end",
        "rule_id", text_lines(F.col("excerpt")).alias("excerpt"), F.unix_seconds("created_at").alias("created_at"))


@query("rule_findings_by_line", f"""WITH {LICENSE_FINDINGS}
SELECT file_path, finding_index, severity, message, line_start, rule_id FROM findings""")
def rule_findings_by_line(spark, folder):
    return find_in_lines(lines(spark, folder), [LICENSES]).select(
        "file_path", "finding_index", "severity", "message", "line_start", "rule_id")


BACKUP_RULES = [("ERROR", 0, "rsync error", ""), ("ERROR", 1, r"\bERROR:", ""), ("ERROR", 2, "FATAL", ""),
                ("ERROR", 3, "Backup FAILED", ""), ("ERROR", 4, "partial transfer", ""), ("ERROR", 5, "license", ""),
                ("WARNING", 0, "WARNING", ""), ("WARNING", 1, r"\bthe\b", "")]


@query("rule_findings_lastrun", f"""WITH {LOGS},
runs AS (SELECT file_path, max(line_no) AS run_start FROM lines
  WHERE regexp_matches(line, '^The and') OR regexp_matches(line, '^Of\\.$') OR regexp_matches(line, '^={{5,}}$')
     OR regexp_matches(line, '^-{{5,}}$') OR regexp_matches(line, '(?i)rsnapshot\\s+\\w+:\\s+started') GROUP BY 1),
kept AS (SELECT l.* FROM lines l LEFT JOIN runs r USING (file_path) WHERE line_no >= coalesce(run_start, 1)
         AND NOT regexp_matches(line, '(?i)reserved')),
hits AS ({hits_sql("kept", BACKUP_RULES)})
SELECT file_path, line_no AS line_start, severity, rule_id,
  concat('rsnapshot ', lower(severity), ' pattern /', rule_id, '/') AS message,
  CAST(row_number() OVER (PARTITION BY file_path ORDER BY {ORDER}) - 1 AS BIGINT) AS finding_index FROM hits""")
def rule_findings_lastrun(spark, folder):
    return find_in_lines(lines(spark, folder), [BACKUPS]).select(
        "file_path", "line_start", "severity", "rule_id", "message", "finding_index")


@query("route_rules", """
SELECT p_partkey, concat('/var/log/', p_type, '/', replace(p_name, ' ', '_'), '.log') AS file_path,
  CASE WHEN regexp_matches(p_name, 'small .*bolt') THEN 'bolts' WHEN regexp_matches(p_type, 'ECONOMY') THEN 'economy'
       WHEN regexp_matches(p_name, '[rb]ing') THEN 'rings' ELSE 'bolts' END AS pipeline FROM part""")
def route_rules(spark, folder):
    path = F.concat(F.lit("/var/log/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".log"))
    sets = [RuleSet("bolts", filename_regex=r"small_.*bolt"), RuleSet("economy", filename_regex=r"/ECONOMY/"),
            RuleSet("rings", filename_regex=r"[rb]ing")]
    parts = table(spark, folder, "part").select("p_partkey", path.alias("file_path"))
    return parts.withColumn("pipeline", route(F.col("file_path"), sets))


def chunk_report(spark, folder, rules):
    chunked = chunk_lines(lines(spark, folder), [rules])
    return chunk_table(chunked).select(
        "file_path", "chunk_no", F.col("chunk_len").cast("long").alias("chunk_len"), "chunk_offset", "first_line",
        "last_line")


CHUNK_SQL = """SELECT file_path, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(chunk_len AS BIGINT) AS chunk_len,
  CAST(coalesce(sum(chunk_len) OVER (PARTITION BY file_path ORDER BY chunk_no
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_offset, first_line, last_line FROM (
  SELECT file_path, chunk_no, count(*) AS chunk_len, min(line_no) AS first_line, max(line_no) AS last_line
  FROM chunked GROUP BY 1, 2)"""


@query("group_whole", f"""WITH {LOGS}, chunked AS (SELECT file_path, 0 AS chunk_no, line_no FROM lines) {CHUNK_SQL}""")
def group_whole(spark, folder):
    return chunk_report(spark, folder, LICENSES)


MARKED_SQL = f"""{LOGS}, flags AS (SELECT file_path, line_no, regexp_matches(line, '^The ') AS opens,
  regexp_matches(line, '\\.$') AND NOT regexp_matches(line, '^The ') AS closes FROM lines),
edges AS (SELECT file_path, line_no, CASE WHEN line_no > 1 AND (opens OR coalesce(lag(closes) OVER w, false))
  THEN 1 ELSE 0 END AS edge FROM flags WINDOW w AS (PARTITION BY file_path ORDER BY line_no)),
chunked AS (SELECT file_path, line_no, sum(edge) OVER (PARTITION BY file_path ORDER BY line_no) AS chunk_no FROM edges)
"""


@query("group_marker", f"WITH {MARKED_SQL} {CHUNK_SQL}")
def group_marker(spark, folder):
    return chunk_report(spark, folder, BY_MARKER)


def doubled_words(chunk):
    """A classifier in Python: lines with a doubled word, with what is known of their chunk."""
    for at, line in enumerate(chunk.lines):
        if "the the" in line:
            yield at, "CRITICAL", f"{len(chunk.before)} before, {at + 1} of {len(chunk.lines)}", "python"


@query("custom_classifier", f"""WITH {MARKED_SQL}, sized AS (SELECT file_path, chunk_no, min(line_no) AS first_line, count(*) AS n
  FROM chunked GROUP BY 1, 2)
SELECT file_path, line_no AS line_start, 'CRITICAL' AS severity, concat(least(2, first_line - 1), ' before, ',
  line_no - first_line + 1, ' of ', n) AS message, line AS excerpt,
  CAST(row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS BIGINT) AS finding_index
FROM lines JOIN chunked USING (file_path, line_no) JOIN sized USING (file_path, chunk_no) WHERE contains(line, 'the the')""")
def custom_classifier(spark, folder):
    register_chunk_classifier("doubled_words", doubled_words)
    rules = replace(BY_MARKER, classifier="doubled_words")
    text = lines(spark, folder).withColumn("pipeline", F.lit(rules.name))
    return find_by_chunk(text, [rules], prefix=2).select(
        "file_path", "line_start", "severity", "message", F.get("excerpt", F.lit(0)).alias("excerpt"), "finding_index")


SEPARATED_SQL = f"""{LOGS}, seps AS (SELECT file_path, line_no, regexp_matches(line, '^[A-D]') AS sep FROM lines),
runs AS (SELECT file_path, line_no, sep, sum(CAST(sep AS INT)) OVER (PARTITION BY file_path ORDER BY line_no) AS run
         FROM seps),
chunked AS (SELECT file_path, line_no, dense_rank() OVER (PARTITION BY file_path ORDER BY run) - 1 AS chunk_no
            FROM runs WHERE NOT sep)"""


@query("group_separator", f"WITH {SEPARATED_SQL} {CHUNK_SQL}")
def group_separator(spark, folder):
    return chunk_report(spark, folder, BY_SEPARATOR)


@query("group_separator_last", f"""WITH {LOGS},
last_sep AS (SELECT file_path, max(line_no) FILTER (regexp_matches(line, '^[A-D]')) AS at FROM lines GROUP BY 1),
chunked AS (SELECT l.file_path, line_no, 0 AS chunk_no FROM lines l JOIN last_sep s USING (file_path)
            WHERE line_no > coalesce(s.at, 0)) {CHUNK_SQL}""")
def group_separator_last(spark, folder):
    return chunk_report(spark, folder, LAST_SEPARATED)


@query("group_last", f"""WITH {MARKED_SQL}
SELECT file_path, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS chunk_len, min(line_no) - 1 AS chunk_offset,
       min(line_no) AS first_line, max(line_no) AS last_line FROM chunked c
WHERE chunk_no = (SELECT max(chunk_no) FROM chunked x WHERE x.file_path = c.file_path) GROUP BY 1, 2""")
def group_last(spark, folder):
    return chunk_report(spark, folder, LAST_MARKED)


@query("group_one_big_log", """WITH e AS (SELECT o_orderkey + 1 AS line_no, CASE WHEN o_orderkey > 0 AND
    (o_orderstatus = 'F' OR coalesce(lag(o_orderstatus) OVER (ORDER BY o_orderkey), '') = 'P') THEN 1 ELSE 0 END AS edge
  FROM orders), c AS (SELECT line_no, sum(edge) OVER (ORDER BY line_no) AS chunk_no FROM e)
SELECT 'orders.log' AS file_path, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS chunk_len,
  min(line_no) - 1 AS chunk_offset, min(line_no) AS first_line, max(line_no) AS last_line FROM c GROUP BY 2""")
def group_one_big_log(spark, folder):
    """All orders as one log file, so every row has the same key."""
    rows = table(spark, folder, "orders").select(
        F.lit("orders.log").alias("file_path"), F.lit(None).cast("string").alias("module"),
        F.lit("orders").alias("pipeline"), F.lit(None).cast("timestamp").alias("mtime"),
        (F.col("o_orderkey") + 1).alias("line_no"), F.col("o_orderstatus").alias("line"))
    rules = RuleSet("orders", grouping=Grouping("marker", start="^F$", end="^P$"))
    return chunk_table(chunk_lines(rows, [rules], bits=12))


def context_sql(prefix: int, suffix: int) -> str:
    return f"""context AS (SELECT h.file_path, h.line_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS excerpt,
      count(*) AS excerpt_len FROM (SELECT DISTINCT file_path, line_no FROM hits) h JOIN lines l
      ON l.file_path = h.file_path AND l.line_no BETWEEN h.line_no - {prefix} AND h.line_no + {suffix} GROUP BY 1, 2)"""


@query("excerpt_context", f"""WITH {LICENSE_FINDINGS}, {context_sql(2, 1)}
SELECT f.file_path, finding_index, line_start, excerpt, excerpt_len FROM findings f
JOIN context c ON c.file_path = f.file_path AND c.line_no = f.line_start""")
def excerpt_context(spark, folder):
    found = find_in_lines(lines(spark, folder), [LICENSES], prefix=2, suffix=1, limit=20)
    return found.select("file_path", "finding_index", "line_start", text_lines(F.col("excerpt")).alias("excerpt"),
                        F.size("excerpt").cast("long").alias("excerpt_len"))


@query("excerpt_capped", f"""WITH {LICENSE_FINDINGS},
around AS (SELECT h.file_path, h.line_no, list(l.line ORDER BY l.line_no) AS ctx,
    count(*) FILTER (l.line_no < h.line_no) AS m FROM (SELECT DISTINCT file_path, line_no FROM hits) h JOIN lines l
    ON l.file_path = h.file_path AND l.line_no BETWEEN h.line_no - 5 AND h.line_no + 4 GROUP BY 1, 2),
cut AS (SELECT file_path, line_no, ctx, greatest(0, least(greatest(0, m - 2), len(ctx) - 4)) AS start FROM around)
SELECT f.file_path, finding_index, line_start, array_to_string(ctx[start + 1 : start + 4], chr(10)) AS excerpt
FROM findings f JOIN cut c ON c.file_path = f.file_path AND c.line_no = f.line_start""")
def excerpt_capped(spark, folder):
    found = find_in_texts(document_bodies(spark, folder), [LICENSES], prefix=5, suffix=4, limit=4)
    return found.select("file_path", "finding_index", "line_start", text_lines(F.col("excerpt")).alias("excerpt"))


@query("separator_findings", f"""WITH {SEPARATED_SQL},
offs AS (SELECT file_path, line_no, chunk_no, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS line_start
         FROM chunked), kept AS (SELECT l.*, o.chunk_no, o.line_start FROM lines l JOIN offs o USING (file_path, line_no)),
hits AS ({hits_sql("kept", [("ERROR", 0, "license", ""), ("WARNING", 0, chr(92) + "bthis" + chr(92) + "b", "")])})
SELECT file_path, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(line_start AS BIGINT) AS line_start,
  line_no AS physical_line_no, severity, rule_id,
  CAST(row_number() OVER (PARTITION BY file_path ORDER BY {ORDER}) - 1 AS BIGINT) AS finding_index FROM hits""")
def separator_findings(spark, folder):
    return find_in_lines(lines(spark, folder), [BY_SEPARATOR]).select(
        "file_path", "chunk_no", "line_start", "physical_line_no", "severity", "rule_id", "finding_index")


@query("text_scan", f"""WITH {LOGS} SELECT file_path, count(*) AS n_lines, true AS in_order, sum(length(line)) AS n_chars
FROM lines GROUP BY 1""".replace("sum(length(line))", "CAST(sum(length(line)) AS BIGINT)"))
def text_scan(spark, folder):
    """Logs written as text files, one after another, and scanned again: their lines must be numbered consecutively."""
    written = lines(spark, folder).repartition("file_path").sortWithinPartitions("file_path", "line_no")
    target = new_folder(spark, "text")
    sinks.write_text(written.select(F.concat_ws("|", "file_path", "line_no", "line").alias("value")), target)
    parts = F.split("line", r"\|", 3)
    scanned = scan_text(spark, [target]).select(
        parts[0].alias("log"), (F.col("line_no") - parts[1].cast("long")).alias("shift"), parts[2].alias("text"))
    return scanned.groupBy(F.col("log").alias("file_path")).agg(
        F.count("*").alias("n_lines"), (F.min("shift") == F.max("shift")).alias("in_order"),
        F.sum(F.length("text")).alias("n_chars"))


# The batch run: logs as files below folders whose names hold a blank; each folder has its rule set, found by its path.
MAIL, WEB = "mail logs", "web logs"


@query("batch_run", f"""WITH {LICENSE_FINDINGS}, d AS (SELECT *, doc_id % 3 = 0 AS mail FROM findings),
kept AS (SELECT * FROM d WHERE mail OR severity = 'ERROR')
SELECT doc_id, CASE WHEN mail THEN 'mail' ELSE 'web' END AS pipeline_name, severity, message, line_start, line AS excerpt,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY finding_index) - 1 AS BIGINT) AS finding_index,
  severity = 'ERROR' AS needs_llm, true AS dated FROM kept""")
def batch_run(spark, folder):
    """Texts are written as one file per log, then scanned, routed by anchored patterns, classified and gated."""
    target = plain_folder(spark, new_folder(spark, "batch logs"))
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.when(F.col("doc_id") % 3 == 0, MAIL).otherwise(WEB).alias("kind"), file_folder("doc_id").alias("folder"),
        F.col("doc_id").alias("log"), F.col("text").alias("value"))
    sinks.write_files(docs, target, ["kind", "folder"], "log")
    root = "^" + re.escape(target)
    sets = [RuleSet("web", f"{root}/kind={WEB}/", errors=LICENSES.errors, ignores=LICENSES.ignores),
            RuleSet("mail", f"{root}/kind={MAIL}/", errors=LICENSES.errors, warnings=LICENSES.warnings, ignores=LICENSES.ignores)]
    module = Module("all", target, gate=ModelGate(enabled=True, min_severity="ERROR"))
    return analyze(spark, [target], sets, module).select(
        F.regexp_extract("file_path", r"/log=(\d+)[/.]", 1).cast("long").alias("doc_id"), "pipeline_name", "severity", "message",
        F.col("line_start").cast("long").alias("line_start"), F.get("excerpt", F.lit(0)).alias("excerpt"),
        F.col("finding_index").cast("long").alias("finding_index"), "needs_llm", F.col("created_at").isNotNull().alias("dated"))

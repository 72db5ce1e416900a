"""Queries on gates, payloads, alerts, providers, messages and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.operators import budget, conversation, payloads
from logquarry.operators.classify import find_in_texts
from logquarry.plans.log_queries import LICENSE_FINDINGS, LICENSES
from logquarry.plans.registry import FOUND, query
from logquarry.sources.tables import document_bodies, event_findings, table
from logquarry.operators import rules
from logquarry.operators.explore import local_time
from logquarry.sources import sinks
from logquarry.spec import AlertChannel, ModelGate, RuleSet

GATE = ModelGate(enabled=True, min_severity="ERROR", max_excerpt_lines=3, context_prefix_lines=1,
                 context_suffix_lines=1,
                 template="[{severity}] {reason} in {file_path} ({pipeline}), {line_count} lines\n")

BAD_WORDS = "error|failed|failure|exception|traceback|fatal|critical|warning|warn"


def gated(spark, folder):
    found = find_in_texts(document_bodies(spark, folder), [LICENSES], prefix=1, suffix=1, limit=20)
    return found.withColumn("needs_llm", payloads.needs_model(GATE, F.col("severity_rank"), F.col("excerpt")))


PAYLOAD_SQL = f"""WITH {LICENSE_FINDINGS},
ctx AS (SELECT f.*, (SELECT list(l.line ORDER BY l.line_no) FROM lines l WHERE l.file_path = f.file_path
        AND l.line_no BETWEEN f.line_start - 1 AND f.line_start + 1) AS excerpt FROM findings f),
gated AS (SELECT *, severity = 'ERROR' AND len(excerpt) BETWEEN 1 AND 3 AS needs_llm,
          [x FOR x IN excerpt IF regexp_matches(lower(x), '{BAD_WORDS}')] AS bad FROM ctx),
quoted AS (SELECT *, CASE WHEN len(bad) = 0 THEN excerpt ELSE bad END AS q FROM gated)"""


@query("gate_payload", PAYLOAD_SQL + """
SELECT file_path, finding_index, needs_llm,
 concat(pipeline_name, '_', severity, '_finding', finding_index, '.txt') AS payload_name,
 CASE WHEN needs_llm THEN concat('[', severity, '] ', message, ' in ', file_path, ' (', pipeline_name, '), ', len(q),
   ' lines', chr(10), chr(10), '----- BEGIN LOG CHUNK -----', chr(10), array_to_string(q, chr(10)), chr(10),
   '----- END LOG CHUNK -----', chr(10)) END AS payload FROM quoted""")
def gate_payload(spark, folder):
    return payloads.with_payload(gated(spark, folder), GATE).select(
        "file_path", "finding_index", "needs_llm", "payload_name", "payload")


@query("payload_fallback_header", PAYLOAD_SQL + f"""
SELECT file_path, finding_index, concat('You are analyzing log output from pipeline ''', pipeline_name, '''.', chr(10),
  'Rule-based severity: ', severity, chr(10), 'Reason: ', message, chr(10), 'File: ', file_path, chr(10),
  'Line span: ', line_start, '-', line_end, chr(10), chr(10),
  '{payloads.TEMPLATE_FAILED_REQUEST.strip().replace("'", "''")}', chr(10), chr(10), '----- BEGIN LOG CHUNK -----', chr(10),
  array_to_string(excerpt, chr(10)), chr(10), '----- END LOG CHUNK -----', chr(10)) AS payload FROM quoted
WHERE needs_llm""")
def payload_fallback_header(spark, folder):
    gate = ModelGate(enabled=True, template="{severity} with {error_count} error lines")
    found = payloads.with_payload(gated(spark, folder), gate, mode="all")
    return found.where("needs_llm").select("file_path", "finding_index", "payload")


@query("derived_counts", f"""WITH {FOUND} SELECT id, CAST(len(excerpt) AS BIGINT) AS line_count,
  CAST(CASE WHEN upper(severity) IN ('ERROR', 'CRITICAL') THEN 1 ELSE 0 END AS BIGINT) AS error_count,
  CAST(CASE WHEN upper(severity) = 'WARNING' THEN 1 ELSE 0 END AS BIGINT) AS warning_count,
  CASE WHEN upper(severity) IN ('WARNING', 'ERROR', 'CRITICAL') THEN upper(severity) ELSE 'WARNING' END
    AS severity_known, excerpt[1] AS preview FROM stored""")
def derived_counts(spark, folder):
    found = payloads.derived_counts(event_findings(spark, folder))
    return found.select("id", "line_count", "error_count", "warning_count", "severity_known",
                        payloads.excerpt_preview(F.col("excerpt"), 1).alias("preview"))


@query("alert_routing", f"""WITH {FOUND}, channels AS (SELECT concat('m', CAST(g AS VARCHAR)) AS module_name,
  r_name AS channel, concat('topic/', lower(r_name)) AS target, CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END
  AS floor FROM region, range(0, 10) t(g))
SELECT id, s.module_name, channel, target, severity, message, line_start FROM stored s JOIN channels c
ON s.module_name = c.module_name WHERE CASE upper(severity) WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2
  WHEN 'CRITICAL' THEN 3 END >= floor""")
def alert_routing(spark, folder):
    region = table(spark, folder, "region")
    channels = region.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("g")).select(
        F.concat(F.lit("m"), F.col("g")).alias("module"), F.col("r_name").alias("channel"),
        F.concat(F.lit("topic/"), F.lower("r_name")).alias("target"),
        F.when(F.col("r_regionkey") == 0, "WARNING").when(F.col("r_regionkey") == 1, "CRITICAL").otherwise("ERROR")
        .alias("min_severity"), F.lit(True).alias("enabled"))
    return payloads.route_alerts(event_findings(spark, folder), channels).select(
        "id", "module_name", "channel", "target", "severity", "message", "line_start")


def nation_modules(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 4 != 3).alias("llm_enabled"),
        F.when(F.col("n_nationkey") % 3 == 0, F.element_at(F.array(*[F.lit(n) for n in (
            "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]), F.col("n_regionkey") + 1)).alias("provider_name"),
        F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") * 100 + 100).alias("max_output_tokens"))


def region_providers(spark, folder):
    return table(spark, folder, "region").select(
        F.col("r_name").alias("provider"),
        F.concat(F.lit("http://"), F.when(F.col("r_regionkey") % 2 == 0, "vLLM").otherwise("api"), F.lit(".local/v1"))
        .alias("api_base"),
        F.concat(F.lit("model-"), "r_regionkey").alias("model"),
        (F.col("r_regionkey") * 256).alias("provider_max_tokens"),
        F.lit(0.5).alias("temperature"), F.lit(1.0).alias("top_p"))


PROVIDERS_SQL = """WITH mods AS (SELECT n_name AS name, n_nationkey % 4 <> 3 AS on_, CASE WHEN n_nationkey % 3 = 0 THEN
  (['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'])[n_regionkey + 1] END AS own,
  CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey * 100 + 100 END AS own_max FROM nation),
routed AS (SELECT name, provider, CASE WHEN provider IS NOT NULL THEN CAST(coalesce(own_max, nullif(r_regionkey * 256, 0),
  512) AS BIGINT) END AS max_tokens, r_regionkey FROM (SELECT *, CASE WHEN on_ THEN coalesce(own, 'ASIA') END AS provider
  FROM mods) m LEFT JOIN region ON r_name = provider)"""


@query("provider_routing", PROVIDERS_SQL + " SELECT name, provider, max_tokens FROM routed")
def provider_routing(spark, folder):
    routed = payloads.route_providers(nation_modules(spark, folder), region_providers(spark, folder), "ASIA")
    return routed.select("name", "provider", F.col("max_tokens").cast("long").alias("max_tokens"))


@query("chat_request", PROVIDERS_SQL + f""" SELECT name, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_messages,
  CASE WHEN r_regionkey % 2 = 0 THEN 'user' ELSE 'system' END AS first_role,
  CASE WHEN r_regionkey % 2 = 0 THEN concat('{payloads.SYSTEM_MESSAGE}', chr(10), chr(10), 'check ', name)
       ELSE concat('check ', name) END AS final_content, CAST(floor((length('{payloads.SYSTEM_MESSAGE}')
       + length(concat('check ', name)) + CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 0 END) / 4) + max_tokens AS BIGINT)
       AS estimated_tokens FROM routed WHERE provider IS NOT NULL""")
def chat_request(spark, folder):
    routed = payloads.route_providers(nation_modules(spark, folder), region_providers(spark, folder), "ASIA")
    ready = routed.where("provider IS NOT NULL").withColumns(
        {"payload": F.concat(F.lit("check "), "name"), "cited": F.lit(False)})
    sent = payloads.chat_request(ready)
    schema = "messages array<struct<role:string,content:string>>, max_tokens long"
    body = F.from_json("request", schema)
    return sent.withColumn("b", body).select(
        "name", F.size("b.messages").cast("long").alias("n_messages"),
        F.col("b.messages")[0]["role"].alias("first_role"),
        F.element_at("b.messages", -1)["content"].alias("final_content"),
        payloads.token_estimate(F.col("b.messages.content"), F.col("b.max_tokens")).cast("long").alias(
            "estimated_tokens"))


@query("token_estimate", """SELECT conv_id, CAST(floor(sum(length(text)) / 4) + 512 AS BIGINT) AS estimated_tokens
FROM conversations GROUP BY 1""")
def token_estimate(spark, folder):
    return conversation.conversation_tokens(table(spark, folder, "conversations"), 512)


def events_log(spark, folder):
    """Each event as a model call: its type is the provider, its value decides the tokens."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("provider"), F.col("event_id").alias("request_id"),
        budget.micros(F.col("ts")).alias("at_us"), (F.floor("value") * 4 + 100).cast("long").alias("estimated"),
        F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.floor(F.col("value") * 3) + 50).cast("long").alias("used"))


LOG_SQL = """log AS (SELECT event_type AS provider, event_id AS request_id, epoch_us(ts) AS at_us,
  CAST(floor(value) * 4 + 100 AS BIGINT) AS estimated,
  CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value * 3) + 50 END AS BIGINT) AS used FROM events)"""


@query("token_window", f"""WITH {LOG_SQL}
SELECT DISTINCT provider, at_us,
 CAST(sum(used) OVER (PARTITION BY provider ORDER BY at_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT)
   AS in_hour,
 CAST(sum(used) OVER (PARTITION BY provider ORDER BY at_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT)
   AS in_day FROM log""")
def token_window(spark, folder):
    log = events_log(spark, folder).withColumnRenamed("used", "tokens")
    return budget.rolling_usage(log, {"in_hour": budget.HOUR, "in_day": budget.DAY}).drop("used")


HOURLY = {"error": 2500, "click": 1500, "view": 4000}
DAILY = {"error": 14000, "purchase": 12000}


@query("budget_admission", f"""WITH RECURSIVE {LOG_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_us, request_id) AS n,
  CASE provider WHEN 'error' THEN 2500 WHEN 'click' THEN 1500 WHEN 'view' THEN 4000 ELSE 1000000000 END AS hour_cap,
  CASE provider WHEN 'error' THEN 14000 WHEN 'purchase' THEN 12000 ELSE 1000000000 END AS day_cap FROM log),
steps AS (
  SELECT provider, request_id, n, estimated <= hour_cap AND estimated <= day_cap AS admitted,
    CASE WHEN estimated <= hour_cap AND estimated <= day_cap
      THEN [{{'at': at_us, 'spent': CASE WHEN used > 0 THEN used ELSE estimated END}}] ELSE [] END AS log_
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT provider, request_id, n, ok, CASE WHEN ok THEN list_append(recent,
      {{'at': at_us, 'spent': CASE WHEN used > 0 THEN used ELSE estimated END}}) ELSE recent END
  FROM (SELECT *, coalesce(list_sum([x.spent FOR x IN recent IF x.at >= at_us - 3600000000]), 0)
          + estimated <= hour_cap AND
        coalesce(list_sum([x.spent FOR x IN recent]), 0) + estimated <= day_cap AS ok
    FROM (SELECT r.*, [x FOR x IN s.log_ IF x.at >= r.at_us - 86400000000] AS recent
          FROM steps s JOIN numbered r ON r.provider = s.provider AND r.n = s.n + 1) a) b)
SELECT provider, request_id, admitted FROM steps""")
def budget_admission(spark, folder):
    return budget.admit(events_log(spark, folder), HOURLY, DAILY).select("provider", "request_id", "admitted")


CHAT_SQL = """msgs AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END
    AS role, text FROM conversations WHERE regexp_matches(text, '\\S')),
spoken AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM msgs WHERE role <> 'system'
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM spoken),
system AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS block FROM msgs WHERE role = 'system'
    GROUP BY 1),
firsts AS (SELECT n.conv_id, min(role) AS first_role FROM numbered n WHERE island = 1 GROUP BY 1),
fixed AS (SELECT n.conv_id, turn, text, CASE WHEN f.first_role = 'assistant' AND s.block IS NULL AND island <= 2 THEN 1
      ELSE island END AS island, CASE WHEN island = 1 AND f.first_role = 'assistant' AND s.block IS NULL THEN 'user'
      ELSE role END AS role FROM numbered n JOIN firsts f USING (conv_id) LEFT JOIN system s USING (conv_id)),
merged AS (SELECT conv_id, island, min(turn) AS first_turn, arg_min(role, turn) AS role,
      string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM fixed GROUP BY 1, 2)"""


@query("message_alternation", f"""WITH {CHAT_SQL}
SELECT m.conv_id, first_turn, role, CASE WHEN island = 1 AND role = 'user' AND block IS NOT NULL
  THEN concat(block, chr(10), chr(10), content) ELSE content END AS content
FROM merged m LEFT JOIN system s USING (conv_id)
UNION ALL
SELECT s.conv_id, -1, 'user', block FROM system s LEFT JOIN firsts f USING (conv_id)
WHERE f.first_role IS NULL OR f.first_role = 'assistant'""")
def message_alternation(spark, folder):
    return conversation.alternate(table(spark, folder, "conversations"))


@query("message_alternation_shuffled_roles", f"""WITH conversations AS (SELECT conv_id, turn, CASE (conv_id + turn * turn) % 5
  WHEN 0 THEN 'assistant' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' WHEN 3 THEN 'user' ELSE role END AS role, text
  FROM conversations), {CHAT_SQL}
SELECT m.conv_id, first_turn, role, CASE WHEN island = 1 AND role = 'user' AND block IS NOT NULL
  THEN concat(block, chr(10), chr(10), content) ELSE content END AS content
FROM merged m LEFT JOIN system s USING (conv_id)
UNION ALL
SELECT s.conv_id, -1, 'user', block FROM system s LEFT JOIN firsts f USING (conv_id)
WHERE f.first_role IS NULL OR f.first_role = 'assistant'""")
def message_alternation_shuffled_roles(spark, folder):
    pick = (F.col("conv_id") + F.col("turn") * F.col("turn")) % 5
    mixed = table(spark, folder, "conversations").withColumn(
        "role", F.when(pick <= 1, "assistant").when(pick == 2, "tool").when(pick == 3, "user").otherwise(F.col("role")))
    return conversation.alternate(mixed)


@query("system_split", """SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, max(turn), 'system', arg_max(text, turn) FROM conversations WHERE role = 'system' GROUP BY 1""")
def system_split(spark, folder):
    return conversation.split_system(table(spark, folder, "conversations"))


SUMMARY = f"""{LICENSE_FINDINGS}, gated AS (SELECT *, severity = 'ERROR' AS needs_llm FROM findings)"""


def summarised(spark, folder):
    found = find_in_texts(document_bodies(spark, folder), [LICENSES])
    gate = ModelGate(enabled=True, min_severity="ERROR")
    return found.withColumn("needs_llm", payloads.needs_model(gate, F.col("severity_rank"), F.col("excerpt")))


@query("summary_text", f"""WITH {SUMMARY} SELECT concat(file_path, ' [', pipeline_name, '] finding=', finding_index, chr(10),
  '  severity: ', severity, chr(10), '  reason:   ', message, chr(10), '  lines:    ', line_start, '-', line_end, chr(10),
  '  needs_llm: True', chr(10)) AS value FROM gated WHERE severity = 'ERROR'""")
def summary_text(spark, folder):
    return sinks.summary_text(summarised(spark, folder), "ERROR")


@query("summary_json", f"""WITH {SUMMARY} SELECT CAST(to_json({{'file_path': file_path, 'pipeline': pipeline_name,
  'finding_index': finding_index, 'severity': severity, 'reason': message, 'needs_llm': needs_llm,
  'line_start': line_start, 'line_end': line_end}}) AS VARCHAR) AS value FROM gated""")
def summary_json(spark, folder):
    return sinks.summary_json(summarised(spark, folder))


@query("alert_json", f"""WITH {FOUND} SELECT id, c AS channel, CAST(to_json({{'module': module_name, 'file_path': file_path,
  'pipeline': pipeline_name, 'severity': severity, 'reason': message, 'line_start': line_start, 'line_end': line_end}})
  AS VARCHAR) AS body FROM stored, (VALUES ('webhook', 2), ('mqtt', 1)) t(c, floor) WHERE module_name IN ('m1', 'm2')
  AND CASE upper(severity) WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'CRITICAL' THEN 3 END >= floor""")
def alert_json(spark, folder):
    channels = [AlertChannel(m, c, "x", s) for m in ("m1", "m2") for c, s in (("webhook", "ERROR"), ("mqtt", "WARNING"))]
    return payloads.alert_records(event_findings(spark, folder), channels).select("id", "channel", "body")


@query("answer_json", """SELECT concat(lang, '_', 'ERROR_finding', doc_id, '_response.json') AS file_name,
  CAST(to_json({'provider': source, 'model': lang, 'content': text, 'prompt_tokens': n_chars, 'completion_tokens': NULL})
  AS VARCHAR) AS value FROM documents""")
def answer_json(spark, folder):
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("pipeline_name"), F.lit("ERROR").alias("severity"), F.col("doc_id").alias("finding_index"),
        F.col("source").alias("llm_provider"), F.col("lang").alias("llm_model"), F.col("text").alias("llm_response_content"),
        F.col("n_chars").alias("llm_prompt_tokens"), F.lit(None).cast("long").alias("llm_completion_tokens"))
    return sinks.answer_json(rows)


@query("parse_answers", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE concat(text, '|', role) END AS content,
  CASE WHEN turn % 2 = 0 THEN 'm' ELSE 'own' END AS model, length(text) AS prompt_tokens FROM conversations""")
def parse_answers(spark, folder):
    """Half of the messages as answers of one format, half as answers of the other."""
    rows = table(spark, folder, "conversations")
    size = F.length("text").cast("long")
    chat = F.struct(
        F.lit("m").alias("model"),
        F.array(F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))).alias("choices"),
        F.struct(size.alias("prompt_tokens")).alias("usage"))
    blocks = F.struct(
        F.array(*[F.struct(F.lit(kind).alias("type"), text.alias("text")) for kind, text in (
            ("text", F.col("text")), ("image", F.lit("no")), ("text", F.concat(F.lit("|"), "role")))]).alias("content"),
        F.struct(size.alias("input_tokens")).alias("usage"))
    response = F.when(F.col("turn") % 2 == 0, F.to_json(chat)).otherwise(F.to_json(blocks))
    parsed = payloads.parse_response(rows.withColumn("response", response), "own")
    return parsed.select("conv_id", "turn", F.col("llm_response_content").alias("content"), F.col("llm_model").alias("model"),
                         F.col("llm_prompt_tokens").alias("prompt_tokens"))


@query("module_binding", """SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'rest' WHEN regexp_matches(n_name, '_1')
  THEN 'ones' WHEN regexp_matches(n_name, '[3-5]$') THEN 'middle' ELSE 'ones' END AS bound FROM nation""")
def module_binding(spark, folder):
    sets = [RuleSet("ones", "/NATION_1"), RuleSet("middle", r"[3-5]\.log$"), RuleSet("rest", "nothing")]
    modules = table(spark, folder, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("/logs/"), "n_name", F.lit(".log")).alias("path"),
        F.when(F.col("n_nationkey") % 4 == 0, "rest").alias("pipeline"))
    return rules.bind_modules(modules, sets).select("name", "bound")


@query("local_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events")
def local_times(spark, folder):
    return table(spark, folder, "events").select("event_id", local_time(F.col("ts").cast("timestamp")).alias("shown"))

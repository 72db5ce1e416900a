"""Log pages with their findings, and the workbench for rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.patterns import java
from logquarry.functions.text import clip, regex_template, strip, text_lines
from logquarry.operators.stats import recent_findings
from logquarry.schema import SEVERITY_RANK
from logquarry.staging import broadcast_if_small, only_wanted, stage

PAGE_LINES = 500
PAGE_CHARS = 4000
SAMPLE_CHARS = 2000
PREVIEW_CHARS = 240
ERROR_LISTING_LINES = 200

# Fixed value: the header line that a findings listing puts before an excerpt.
HEADER_LINE = r"^\[[A-Z]+\]\s+finding #\d+\s+@"


def page(lines: DataFrame, limit: int = PAGE_LINES, offset: int = 0, max_chars: int = PAGE_CHARS) -> DataFrame:
    """Per file, the `limit` lines before the last `offset` ones, with start_line, total_lines, has_more, next_offset.

    Totals are one row per file. Where they are few they are broadcast and the lines never move; where they are not, an
    adaptive join splits the files that dominate.
    """
    totals = broadcast_if_small(stage(
        lines.groupBy("file_path").agg(F.max("line_no").alias("total_lines")), "totals"))
    first = F.greatest(F.lit(0), F.col("total_lines") - offset - limit) + 1
    bounds = totals.where(F.col("total_lines") > offset).select(
        "file_path", "total_lines", first.alias("start_line"), (F.col("total_lines") - offset).alias("end_line"))
    joined = lines.join(bounds, "file_path").where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return joined.select(
        "file_path", "module", "line_no", F.substring("line", 1, max_chars).alias("line"), "start_line", "total_lines",
        (F.col("start_line") > 1).alias("has_more"),
        (F.lit(offset) + F.col("end_line") - F.col("start_line") + 1).alias("next_offset"))


def newest_per_line(findings: DataFrame) -> DataFrame:
    """The newest finding of each line. An aggregate, so many findings of one line collapse before the shuffle."""
    rest = [c for c in findings.columns if c not in ("file_path", "line_start")]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("f")
    return findings.groupBy("file_path", "line_start").agg(newest).select("file_path", "line_start", "f.*")


def excerpt_line(excerpt: Column, rule_id: Column, patterns: list[str]) -> Column:
    """The excerpt line that the finding's rule matches, else the middle one; NULL without a rule."""
    def first_match(pattern: str) -> Column:
        return F.get(F.filter(excerpt, lambda line: line.rlike(java(pattern))), F.lit(0))

    matching = F.coalesce(F.lit(None).cast("string"), *[F.when(rule_id == p, first_match(p)) for p in patterns])
    middle = F.get(excerpt, F.floor(F.size(excerpt) / 2).cast("int"))
    return F.when(F.length(rule_id) > 0, F.coalesce(matching, middle))


def log_view(shown: DataFrame, findings: DataFrame, lines: DataFrame, patterns: list[str],
             limit: int | None = None) -> DataFrame:
    """Page lines with their newest finding, plus lines of findings that are not on the page.

    With a `limit`, only so many of the newest findings of each module are looked at.
    Those take their text from the file, else from the excerpt; without either the finding is left out.
    """
    recent = newest_per_line(recent_findings(findings, limit)).withColumnRenamed("line_start", "line_no").select(
        "file_path", "line_no", F.struct("id", "severity", "message", "rule_id", "created_at").alias("finding"),
        excerpt_line(F.col("excerpt"), F.col("rule_id"), patterns).alias("quoted"))
    recent = stage(recent, "recent")
    texts = only_wanted(lines.select("file_path", "line_no", F.col("line").alias("file_line")),
                        ["file_path", "line_no"], recent)
    known = recent.join(texts, ["file_path", "line_no"], "left")
    view = shown.select("file_path", "line_no", "line", F.lit(True).alias("on_page")).join(
        known, ["file_path", "line_no"], "full_outer")
    return view.select(
        "file_path", "line_no", F.coalesce("line", "file_line", "quoted").alias("text"),
        F.coalesce("on_page", F.lit(False)).alias("on_page"), "finding.*",
    ).where(F.col("on_page") | F.col("text").isNotNull())


def filter_view(view: DataFrame, severity: str = "ALL", active_only: bool = False) -> DataFrame:
    """Lines with findings of one severity; ALL keeps plain lines too. `active_only` drops findings off the scale."""
    upper = F.upper("severity")
    if active_only:
        view = view.where(F.col("id").isNull() | upper.isin(*SEVERITY_RANK))
    name = (severity or "ALL").upper()
    return view if name in ("", "ALL") else view.where(upper == name)


def severity_facet(view: DataFrame) -> DataFrame:
    """Severities shown per file, ordered by the first line that shows them."""
    upper = F.upper("severity")
    return view.where(F.length("severity") > 0).groupBy("file_path", upper.alias("severity")).agg(
        F.min("line_no").alias("first_line"))


def displayed_findings(view: DataFrame) -> DataFrame:
    """Distinct findings shown per file."""
    shown = view.where(F.col("id").isNotNull()).select("file_path", "id").distinct()
    return shown.groupBy("file_path").agg(F.count("*").alias("n_findings"))


def line_examples(view: DataFrame) -> DataFrame:
    """The first non-empty line text of each finding shown."""
    return view.where(F.col("id").isNotNull() & (F.length("text") > 0)).groupBy("id").agg(
        F.min_by("text", "line_no").alias("example"))


def local_time(ts: Column, zone: str = "UTC") -> Column:
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.coalesce(F.concat(F.date_format(shifted, "yyyy-MM-dd HH:mm:ss"), F.lit(" " + zone)), F.lit(""))


def error_lines(findings: DataFrame, limit: int = ERROR_LISTING_LINES, zone: str = "UTC") -> DataFrame:
    """Per module, recent findings as a header line and their excerpt, cut to `limit` lines in all.

    At most `limit` findings per module get that far, each with a bounded excerpt.
    """
    header = F.concat(F.lit("["), "severity", F.lit("] finding #"), F.col("finding_index").cast("string"), F.lit(" @ "),
                      local_time(F.col("created_at"), zone))
    body = F.when(F.length(text_lines(F.col("excerpt"))) > 0, F.col("excerpt")).otherwise(
        F.array().cast("array<string>"))
    rows = unfold(recent_findings(findings, limit), ["module_name", "nth"],
                  F.slice(F.concat(F.array(header), body), 1, limit), "line", "slot")
    order = Window.partitionBy("module_name").orderBy("nth", "slot")
    numbered = rows.select("module_name", F.row_number().over(order).cast("long").alias("line_no"), "line")
    return numbered.where(F.col("line_no") <= limit)


def without_headers(lines: DataFrame) -> DataFrame:
    """Drop generated header lines."""
    return lines.where(~strip(F.col("line")).rlike("(?i)" + HEADER_LINE))


def samples(lines: DataFrame) -> DataFrame:
    """Lines clipped for display, with what was cut."""
    full = F.substring("line", 1, SAMPLE_CHARS)
    return lines.select(
        "file_path", "line_no", clip(full, PREVIEW_CHARS, "…").alias("preview"), full.alias("full"),
        (F.length(full) > PREVIEW_CHARS).alias("is_preview_truncated"),
        (F.length("line") > SAMPLE_CHARS).alias("was_clipped"))


def rule_matches(lines: DataFrame, pattern: str) -> DataFrame:
    """The lines a candidate pattern matches (case matters)."""
    return lines.where(F.col("line").rlike(java(pattern))).select("file_path", "line_no")


def match_rates(lines: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Matches and share of all lines per named rule (label, pattern, kind), in one pass over the lines."""
    totals = lines.agg(
        F.count("*").alias("n_lines"),
        *[F.count_if(F.col("line").rlike(java(p))).alias(f"rule_{i}") for i, (_, p, _) in enumerate(rules)])
    entries = [F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.col(f"rule_{i}").alias("n_matches"))
               for i, (label, _, kind) in enumerate(rules)]
    return totals.select("n_lines", F.explode(F.array(*entries)).alias("r")).select(
        "r.*", "n_lines", F.round(F.col("r.n_matches") / F.col("n_lines"), 9).alias("rate"))


def line_templates(lines: DataFrame) -> DataFrame:
    """Lines grouped by the pattern that would be suggested for them."""
    return lines.groupBy(regex_template(F.col("line")).alias("template")).agg(F.count("*").alias("n_lines"))

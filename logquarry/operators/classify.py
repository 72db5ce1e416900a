"""Findings from lines: rule matches, their order per file, and context excerpts.

Two forms with the same result. `find_in_lines` takes a table of numbered lines of any length per file. It reads the
text once, keeps only matched lines and chunk boundaries (a staged, sparse table), and does all ordering on that.
`find_in_texts` takes rows that hold a whole chunk of lines (a document, an arrived log segment) and works inside the
row, without any shuffle.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.patterns import find_all
from logquarry.operators.grouping import chunk_lines, grouping_kind, has_mark, needs_placing, place, starts_run, with_marks
from logquarry.operators.ordered import BLOCK_BITS, along
from logquarry.operators.rules import CHUNK_CLASSIFIERS, HIT_TYPE, Chunk, hits, is_hit, message, pick, rules_in_order
from logquarry.schema import SEVERITY_RANK
from logquarry.spec import RuleSet
from logquarry.staging import broadcast_if_small, only_wanted, stage

IDS = ["file_path", "module", "pipeline", "mtime"]


def matched_lines(lines: DataFrame, rule_sets: list[RuleSet], *, staged: bool = True,
                  bits: int = BLOCK_BITS) -> DataFrame:
    """One row per kept line with at least one hit: its place in its chunk and its hits."""
    line = F.col("line")
    hit = pick(rule_sets, lambda r: is_hit(line, r))
    found = F.when(hit, pick(rule_sets, lambda r: hits(line, r))).otherwise(F.array().cast(f"array<{HIT_TYPE}>"))
    if any(needs_placing(r) for r in rule_sets) and all(grouping_kind(r) == "whole_file" for r in rule_sets):
        # One chunk per file: the last run begins at the greatest marker, one row per file. Only what follows is matched.
        kept = last_runs(lines, rule_sets).where(hit).withColumn("hits", pick(rule_sets, lambda r: hits(line, r)))
        rows = kept.withColumns({
            "chunk_no": F.lit(0).cast("long"), "chunk_start": F.lit(1).cast("long"),
            "segment_start": F.coalesce("run_start", F.lit(1)).cast("long"), "stop": F.lit(None).cast("long"),
            "line_start": F.col("line_no")}).drop("run_start")
        if staged:
            rows = stage(rows, "placed")
    elif any(needs_placing(r) for r in rule_sets):
        marked = with_marks(lines, rule_sets)
        notes = marked.where(has_mark() | hit).withColumn("hits", found)
        if staged:
            notes = stage(notes, "notes")
        rows = place(notes, notes, lines, rule_sets, bits).where(F.size("hits") > 0)
        rows = rows.drop("opens", "closes", "separates", "starts_run")
        if staged:
            rows = stage(rows, "placed")
    else:
        rows = lines.where(hit).withColumn("hits", pick(rule_sets, lambda r: hits(line, r)))
        if staged:
            rows = stage(rows, "notes")
        rows = rows.withColumns({
            "chunk_no": F.lit(0).cast("long"), "chunk_start": F.lit(1).cast("long"),
            "segment_start": F.lit(1).cast("long"), "stop": F.lit(None).cast("long"), "line_start": F.col("line_no")})
    return rows


def last_runs(lines: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """Lines from the last run marker of their file on, with its number as run_start; all lines where there is none or
    the rule set counts every run."""
    begins = lines.where(pick(rule_sets, lambda r: starts_run(F.col("line"), r))).groupBy(
        F.col("file_path").alias("marked_file")).agg(F.max("line_no").alias("run_start"))
    joined = lines.join(broadcast_if_small(stage(begins, "runs")), F.col("file_path") == F.col("marked_file"), "left")
    return joined.drop("marked_file").where(F.col("line_no") >= F.coalesce("run_start", F.lit(1)))


def with_first_index(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add the index of a line's first finding: the number of findings before it in its file."""
    n_hits = F.element_at("hits", -1)["skipped"] + F.size(F.element_at("hits", -1)["texts"])
    counted = along(rows, ["file_path"], "line_no", sums={"hits_so_far": n_hits}, bits=bits)
    return counted.withColumn("first_index", (F.col("hits_so_far") - n_hits).cast("long")).drop("hits_so_far")


def with_excerpts(rows: DataFrame, matched: DataFrame, lines: DataFrame, prefix: int = 0, suffix: int = 0, limit: int = 20,
                  compat_prefix: bool = False, staged: bool = True) -> DataFrame:
    """Add to `rows` the excerpt: lines before, the match, lines after, cut to `limit` lines around the match.

    `matched` are the same lines with their places. Lines are gathered in blocks at least as long as a window, each
    wanted block once; a match meets the one or two blocks that its window lies in and takes its lines from them. The
    work follows the number of lines and matches, not matches times the window, also where every line matches. Lines
    before the match that its chunk lacks are taken from in front of the chunk. `compat_prefix` repeats those lines also
    where nothing is lacking.
    """
    if prefix <= 0 and suffix <= 0:
        return rows.withColumn("excerpt", F.array("line"))
    at = F.col("line_no")
    first = F.greatest(F.col("segment_start"), at - prefix)
    lacking = F.greatest(F.lit(0), prefix - (at - first))
    if compat_prefix:
        lacking = F.when(lacking == 0, prefix).otherwise(lacking)
    borrowed = F.least(lacking, F.col("chunk_start") - 1)
    final = F.least(at + suffix, F.coalesce(F.col("stop") - 1, at + suffix))
    bits = max(3, (prefix + suffix).bit_length())

    def part(low: Column, high: Column, slot: Column) -> Column:
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), slot.cast("int").alias("slot"))

    parts = F.array(part(F.col("chunk_start") - borrowed, F.col("chunk_start") - 1, F.lit(0)), part(first, final, borrowed))
    pieces = unfold(matched, ["file_path", "line_no", (borrowed + at - first).cast("int").alias("match_slot")],
                    parts, "part").where("part.low <= part.high")
    probes = unfold(pieces, ["file_path", "line_no", "match_slot", "part"],
                    F.sequence(F.shiftright("part.low", bits), F.shiftright("part.high", bits)), "block")
    numbered = lines.select("file_path", F.shiftright("line_no", bits).alias("block"), F.struct("line_no", "line").alias("row"))
    wanted = probes.select("file_path", "block").distinct()
    if staged:
        kept = only_wanted(numbered, ["file_path", "block"], stage(wanted, "blocks"))
    else:
        kept = numbered.join(wanted, ["file_path", "block"], "left_semi")
    blocks = kept.groupBy("file_path", "block").agg(F.collect_list("row").alias("rows"))
    inside = F.filter("rows", lambda r: r["line_no"].between(F.col("part.low"), F.col("part.high")))
    found = F.transform(inside, lambda r: F.struct(
        (r["line_no"] - F.col("part.low") + F.col("part.slot")).cast("int").alias("slot"), r["line"].alias("context_line")))
    context = (
        probes.join(blocks, ["file_path", "block"])
        .select("file_path", "line_no", "match_slot", found.alias("found"))
        .groupBy("file_path", "line_no")
        .agg(F.max("match_slot").alias("match_slot"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        .select("file_path", "line_no", cap(F.col("found.context_line"), F.col("match_slot"), limit).alias("excerpt"))
    )
    return rows.join(context, ["file_path", "line_no"])


def cap(excerpt: Column, match_slot: Column, limit: int) -> Column:
    """At most `limit` lines around the match, moved back where the window passes the end."""
    limit = max(1, limit)
    start = F.greatest(F.lit(0), match_slot - limit // 2)
    start = F.greatest(F.lit(0), F.least(start, F.size(excerpt) - limit))
    return F.slice(excerpt, (start + 1).cast("int"), limit)


def to_findings(matched: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """One row per match, errors before warnings, then rule, then match; `finding_index` counts them per file."""
    per_rule = unfold(
        matched, [*IDS, "chunk_no", "line_no", "line_start", "excerpt", "first_index"], "hits", "hit")
    per_match = unfold(per_rule, ["*"], "hit.texts", "match_text", "match_idx")
    return per_match.select(
        F.col("module").alias("module_name"),
        F.col("pipeline").alias("pipeline_name"),
        "file_path",
        (F.col("first_index") + F.col("hit.skipped") + F.col("match_idx")).alias("finding_index"),
        F.col("hit.severity").alias("severity"),
        F.col("hit.severity_rank").alias("severity_rank"),
        message(rule_sets, F.col("hit.severity"), F.col("hit.rule_id"), F.col("match_text")).alias("message"),
        "line_start",
        F.col("line_start").alias("line_end"),
        F.col("line_no").alias("physical_line_no"),
        "chunk_no",
        F.col("hit.rule_id").alias("rule_id"),
        F.col("hit.rule_idx").alias("rule_idx"),
        "match_idx",
        "match_text",
        "excerpt",
        F.col("mtime").alias("created_at"),
    )


def find_in_lines(lines: DataFrame, rule_sets: list[RuleSet], prefix: int = 0, suffix: int = 0, limit: int = 20, *,
                  compat_prefix: bool = False, staged: bool = True, bits: int = BLOCK_BITS) -> DataFrame:
    """Findings of numbered lines (file_path, module, pipeline, mtime, line_no, line)."""
    matched = matched_lines(lines, rule_sets, staged=staged, bits=bits)
    quoted = with_excerpts(with_first_index(matched, bits), matched, lines, prefix, suffix, limit, compat_prefix,
                           staged)
    return to_findings(quoted, rule_sets)


def text_hits(rules: RuleSet, body: Column, carried: Column, prefix: int, suffix: int, limit: int,
              compat_prefix: bool) -> Column:
    """All hits of one row of lines, in reporting order, each with its excerpt."""
    def context(at: Column) -> Column:
        before = F.least(at, F.lit(prefix))
        lacking = prefix - before
        if compat_prefix:
            lacking = F.when(lacking == 0, prefix).otherwise(lacking)
        borrowed = F.least(lacking, F.size(carried))
        whole = F.concat(
            F.slice(carried, F.size(carried) - borrowed + 1, borrowed),
            F.slice(body, at - before + 1, before + 1 + suffix))
        return cap(whole, borrowed + before, limit)

    def of_rule(line: Column, at: Column, severity: str, idx: int, pattern: str) -> Column:
        excerpt = context(at) if prefix > 0 or suffix > 0 else F.array(line)
        return F.transform(find_all(line, pattern, ignore_case=True), lambda text, k: F.struct(
            at.alias("at"), F.lit(severity).alias("severity"), F.lit(SEVERITY_RANK[severity]).alias("severity_rank"),
            F.lit(idx).alias("rule_idx"), F.lit(pattern).alias("rule_id"), k.alias("match_idx"),
            text.alias("match_text"), excerpt.alias("excerpt")))

    def of_line(line: Column, at: Column) -> Column:
        return F.flatten(F.array(*[of_rule(line, at, *rule) for rule in rules_in_order(rules)]))

    per_line = F.transform(body, lambda line, at: F.when(is_hit(line, rules), of_line(line, at)))
    return F.flatten(F.filter(per_line, lambda found: found.isNotNull()))


def find_in_texts(texts: DataFrame, rule_sets: list[RuleSet], prefix: int = 0, suffix: int = 0, limit: int = 20, *,
                  compat_prefix: bool = False) -> DataFrame:
    """Findings of rows that hold one ungrouped chunk each: (file_path, module, pipeline, mtime, body ARRAY<STRING>).

    Optional columns: start_line and first_index continue a log that arrives in pieces, carried holds the lines before.
    """
    have = set(texts.columns)
    carried = F.col("carried") if "carried" in have else F.array().cast("array<string>")
    start_line = F.col("start_line") if "start_line" in have else F.lit(1)
    first_index = F.col("first_index") if "first_index" in have else F.lit(0)
    found = pick(rule_sets, lambda r: text_hits(r, F.col("body"), carried, prefix, suffix, limit, compat_prefix))
    rows = unfold(
        texts, [*IDS, start_line.cast("long").alias("start_line"), first_index.cast("long").alias("first_index")],
        found, "hit", "nth")
    line_no = F.col("start_line") + F.col("hit.at")
    return rows.select(
        F.col("module").alias("module_name"),
        F.col("pipeline").alias("pipeline_name"),
        "file_path",
        (F.col("first_index") + F.col("nth")).alias("finding_index"),
        F.col("hit.severity").alias("severity"),
        F.col("hit.severity_rank").alias("severity_rank"),
        message(rule_sets, F.col("hit.severity"), F.col("hit.rule_id"), F.col("hit.match_text")).alias("message"),
        line_no.alias("line_start"),
        line_no.alias("line_end"),
        line_no.alias("physical_line_no"),
        F.lit(0).cast("long").alias("chunk_no"),
        F.col("hit.rule_id").alias("rule_id"),
        F.col("hit.rule_idx").alias("rule_idx"),
        F.col("hit.match_idx").alias("match_idx"),
        F.col("hit.match_text").alias("match_text"),
        F.col("hit.excerpt").alias("excerpt"),
        F.col("mtime").alias("created_at"),
    )


CUSTOM_HITS = "array<struct<at:int,severity:string,message:string,rule_id:string>>"


def find_by_chunk(lines: DataFrame, rule_sets: list[RuleSet], prefix: int = 0, limit: int = 20,
                  bits: int = BLOCK_BITS) -> DataFrame:
    """Findings of the Python classifiers that the rule sets name, called once per chunk of any grouping.

    A classifier sees its chunk whole, so a chunk must fit in a task; files may be of any size. `prefix` lines in front
    of the chunk come with it. Offsets outside the chunk are an error. Excerpts are the line itself, cut to `limit`.
    """
    functions = {r.name: CHUNK_CLASSIFIERS[r.classifier] for r in rule_sets}
    keep = [*IDS, "line_no", "line", "chunk_no", "line_start"]
    chunked = chunk_lines(lines, rule_sets, bits).select(*keep, F.lit(False).alias("in_front"))
    if prefix > 0:
        first = chunked.groupBy(*IDS, "chunk_no").agg(F.min("line_no").alias("first"))
        wanted = unfold(first.where("first > 1"), [*IDS, "chunk_no"], F.sequence(
            F.greatest(F.lit(1), F.col("first") - prefix), F.col("first") - 1), "line_no", "slot").drop("slot")
        front = wanted.join(lines.select("file_path", "line_no", "line"), ["file_path", "line_no"])
        chunked = chunked.unionByName(front.select(
            *[c for c in keep if c != "line_start"], F.lit(None).cast("long").alias("line_start"), F.lit(True).alias("in_front")))

    def gathered(kind: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(kind, F.struct("line_no", "line"))))

    chunks = chunked.groupBy(*IDS, "chunk_no").agg(
        gathered(~F.col("in_front")).alias("own"), gathered(F.col("in_front")).alias("front"),
        F.min("line_start").alias("start_line"))

    @F.pandas_udf(CUSTOM_HITS)
    def run(path: pd.Series, pipeline: pd.Series, start: pd.Series, body: pd.Series, front: pd.Series) -> pd.Series:
        return pd.Series([
            [tuple(hit) for hit in functions[p](Chunk(f, p, int(s), list(b), list(w), limit))]
            for f, p, s, b, w in zip(path, pipeline, start, body, front)])

    found = unfold(
        chunks, [*IDS, "own", "start_line"], run("file_path", "pipeline", "start_line", "own.line", "front.line"), "hit", "nth")
    at = F.col("hit.at")
    placed = found.withColumn("line_no", F.element_at("own", at + 1)["line_no"])
    counted = along(placed, ["file_path"], "line_no", ties=["nth"], sums={"number": F.lit(1)}, bits=bits)
    line = (F.col("start_line") + at).cast("long")
    return counted.select(
        F.col("module").alias("module_name"), F.col("pipeline").alias("pipeline_name"), "file_path",
        (F.col("number") - 1).cast("long").alias("finding_index"), F.col("hit.severity").alias("severity"),
        F.col("hit.message").alias("message"), line.alias("line_start"), line.alias("line_end"),
        F.col("hit.rule_id").alias("rule_id"), F.slice(F.array(F.element_at("own", at + 1)["line"]), 1, max(1, limit)).alias("excerpt"),
        F.col("mtime").alias("created_at"))


def custom_chunk_findings(texts: DataFrame, fn: Callable[[str, list[str]], list[tuple]]) -> DataFrame:
    """Findings of a Python classifier that sees a whole chunk: fn(pipeline, lines) -> [(at, severity, message, rule)].

    The chunk is one row, so rows are classified in Arrow batches, in parallel over all rows.
    """
    @F.pandas_udf(CUSTOM_HITS)
    def run(pipeline: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([[tuple(hit) for hit in fn(p, list(b))] for p, b in zip(pipeline, body)])

    rows = unfold(texts, [*IDS, "body"], run("pipeline", "body"), "hit", "finding_index")
    return rows.select(
        F.col("module").alias("module_name"), F.col("pipeline").alias("pipeline_name"), "file_path",
        F.col("finding_index").cast("long").alias("finding_index"), F.col("hit.severity").alias("severity"),
        F.col("hit.message").alias("message"), (F.col("hit.at") + 1).cast("long").alias("line_start"),
        (F.col("hit.at") + 1).cast("long").alias("line_end"), F.col("hit.rule_id").alias("rule_id"),
        F.array(F.get("body", F.col("hit.at"))).alias("excerpt"), F.col("mtime").alias("created_at"))

"""Rule sets as column expressions: routing, the per-line tests, and the hits of one line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logquarry.functions.patterns import any_match, find_all, java
from logquarry.functions.text import match_snippet
from logquarry.schema import SEVERITY_RANK
from logquarry.spec import RuleSet

# What the backup-log classifier looks for besides the configured patterns.
BACKUP_ERRORS = (r"rsync error", r"\bERROR:", r"FATAL", r"Backup FAILED", r"partial transfer")
BACKUP_WARNINGS = (r"WARNING",)
BACKUP_RUN_MARKERS = (r"^={5,}$", r"^-{5,}$")
BACKUP_RUN_MARKERS_ANY_CASE = (r"rsnapshot\s+\w+:\s+started",)

# Named example rules.
PRESET_RULES = (
    ("Errors: HTTP 5xx responses", r"\s5\d{2}\s", "error"),
    ("Errors: Tracebacks", r"Traceback (most recent call last):", "error"),
    ("Warnings: Timeouts or slowness", r"(?i)(timeout|slow query|degraded)", "warning"),
    ("Warnings: Deprecation notices", r"(?i)deprecated|sunsetted", "warning"),
    ("Ignore: Health/status checks", r"(?i)\b(health(check)?|status|metrics)\b", "ignore"),
    ("Ignore: Cache refresh noise", r"Cache refresh completed in \d+ms", "ignore"),
)


def counted_message(severity: str, rule_id: Column, text: Column) -> Column:
    return F.concat(F.lit(f"Matched {severity.lower()} pattern /"), rule_id, F.lit('/ on "'), match_snippet(text),
                    F.lit('"'))


def backup_message(severity: str, rule_id: Column, text: Column) -> Column:
    return F.concat(F.lit(f"rsnapshot {severity.lower()} pattern /"), rule_id, F.lit("/"))


@dataclass(frozen=True)
class Classifier:
    """Extra patterns in front of the configured ones, the wording, and whether only the last run counts."""

    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    message: Callable[[str, Column, Column], Column] = counted_message
    last_run_only: bool = False
    run_markers: tuple[str, ...] = ()
    run_markers_any_case: tuple[str, ...] = ()


CLASSIFIERS: dict[str, Classifier] = {
    "regex_counter": Classifier(),
    "rsnapshot_basic": Classifier(BACKUP_ERRORS, BACKUP_WARNINGS, backup_message, True, BACKUP_RUN_MARKERS,
                                  BACKUP_RUN_MARKERS_ANY_CASE),
}


def register_classifier(name: str, classifier: Classifier) -> None:
    """Make a classifier available to rule sets under `name`."""
    CLASSIFIERS[name] = classifier


@dataclass(frozen=True)
class Chunk:
    """What a classifier written in Python sees: lines of one chunk, those in front of it, and the excerpt limit."""

    file_path: str
    pipeline: str
    start_line: int
    lines: list[str]
    before: list[str]
    limit: int


# By the name that a rule set gives as its classifier: a function of a chunk that gives (offset, severity, message, rule).
CHUNK_CLASSIFIERS: dict[str, Callable[[Chunk], Iterable[tuple[int, str, str, str]]]] = {}


def register_chunk_classifier(name: str, function: Callable[[Chunk], Iterable[tuple[int, str, str, str]]]) -> None:
    """Make a Python classifier available to rule sets under `name`."""
    CHUNK_CLASSIFIERS[name] = function


def classifier_of(rules: RuleSet) -> Classifier:
    return CLASSIFIERS.get(rules.classifier, CLASSIFIERS["regex_counter"])


def pick(rule_sets: list[RuleSet], build: Callable[[RuleSet], Column]) -> Column:
    """`build` for the rule set named in the `pipeline` column; the first one where the name is unknown."""
    if len(rule_sets) == 1:
        return build(rule_sets[0])
    out = reduce(
        lambda acc, r: F.when(F.col("pipeline") == r.name, build(r)) if acc is None
        else acc.when(F.col("pipeline") == r.name, build(r)),
        rule_sets[1:], None)
    return out.otherwise(build(rule_sets[0]))


def route(path: Column, rule_sets: list[RuleSet], override: str | None = None) -> Column:
    """Name of the first rule set whose file pattern is found in the path, else the first of all."""
    if override is not None:
        if override not in {r.name for r in rule_sets}:
            raise ValueError(f"Unknown pipeline {override}")
        return F.lit(override)
    tests = [F.when(path.rlike(java(r.filename_regex)), F.lit(r.name)) for r in rule_sets if r.filename_regex]
    return F.coalesce(*tests, F.lit(rule_sets[0].name))


def with_routing(lines: DataFrame, rule_sets: list[RuleSet], override: str | None = None) -> DataFrame:
    return lines.withColumn("pipeline", route(F.col("file_path"), rule_sets, override))


def rules_in_order(rules: RuleSet) -> list[tuple[str, int, str]]:
    """(severity, position, pattern) in reporting order: errors, then warnings."""
    kind = classifier_of(rules)
    found = [("ERROR", i, p) for i, p in enumerate(kind.errors + rules.errors)]
    return found + [("WARNING", i, p) for i, p in enumerate(kind.warnings + rules.warnings)]


def bind_modules(modules: DataFrame, rule_sets: list[RuleSet]) -> DataFrame:
    """Modules (name, path, pipeline) with `bound`: the rule set they name, else the one their path is routed to.

    A name that no rule set has is an error.
    """
    known = F.col("pipeline").isin([r.name for r in rule_sets])
    unknown = F.raise_error(F.concat(F.lit("Module "), "name", F.lit(": unknown pipeline "), "pipeline")).cast("string")
    named = F.length("pipeline") > 0
    return modules.withColumn("bound", F.when(named & known, F.col("pipeline")).when(named, unknown).otherwise(
        route(F.col("path"), rule_sets)))


def is_hit(line: Column, rules: RuleSet) -> Column:
    """A line that some rule matches and no ignore pattern does; the rarer test comes first."""
    wanted = any_match(line, [p for _, _, p in rules_in_order(rules)], ignore_case=True)
    return wanted & ~any_match(line, rules.ignores, ignore_case=True) if rules.ignores else wanted


HIT_TYPE = "struct<severity:string,severity_rank:int,rule_idx:int,rule_id:string,skipped:int,texts:array<string>>"


def hits(line: Column, rules: RuleSet) -> Column:
    """One entry per rule with all its matches; `skipped` counts the matches of the rules before it."""
    entries, skipped = [], F.lit(0)
    for severity, idx, pattern in rules_in_order(rules):
        texts = find_all(line, pattern, ignore_case=True)
        entries.append(F.struct(
            F.lit(severity).alias("severity"), F.lit(SEVERITY_RANK[severity]).alias("severity_rank"),
            F.lit(idx).alias("rule_idx"), F.lit(pattern).alias("rule_id"),
            skipped.alias("skipped"), texts.alias("texts")))
        skipped = skipped + F.size(texts)
    return F.array(*entries).cast(f"array<{HIT_TYPE}>")


def hit_count(line: Column, rules: RuleSet) -> Column:
    counts = [F.regexp_count(line, F.lit(java(p, True))) for _, _, p in rules_in_order(rules)]
    return reduce(lambda a, b: a + b, counts) if counts else F.lit(0)


def message(rule_sets: list[RuleSet], severity: Column, rule_id: Column, text: Column) -> Column:
    def one(rules: RuleSet) -> Column:
        build = classifier_of(rules).message
        return F.when(severity == "ERROR", build("ERROR", rule_id, text)).otherwise(build("WARNING", rule_id, text))

    return pick(rule_sets, one)

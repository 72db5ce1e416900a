import random
import re

import pytest

import sequential
from logquarry.operators import rules
from logquarry.operators.classify import custom_chunk_findings, find_in_lines, find_in_texts
from logquarry.operators.grouping import chunk_lines
from logquarry.spec import Grouping, RuleSet, read_module, read_rule_sets

MARKERS_LOG = ["before", "BEGIN a", "x error", "END", "between", "BEGIN b", "BEGIN c END", "error y", "END"]
SEPARATORS_LOG = ["lead", "=== 1", "=== 2", "one error", "two", "=== 3", "tail error", "=== 4"]
PLAIN_LOG = ["nothing", "an error here", "more"]


def random_logs(seed, n_files=12, n_lines=60):
    rnd = random.Random(seed)
    pool = ["BEGIN job", "END job", "BEGIN END", "=== cut", "an error and Error", "warn: slow", "noise error", "plain", "",
            "=====", "rsnapshot daily: started", "ERROR: x WARNING"]
    return {f"f{i}.log": [rnd.choice(pool) for _ in range(rnd.randint(0, n_lines))] for i in range(n_files)}


GROUPINGS = [
    Grouping(),
    Grouping("marker", start="BEGIN", end="END"),
    Grouping("marker", start="BEGIN"),
    Grouping("marker", end="END"),
    Grouping("marker", start="BEGIN", end="END", only_last=True),
    Grouping("separator", separator="==="),
    Grouping("separator", separator="===", only_last=True),
    Grouping("separator"),
    Grouping("whole_file", only_last=True),
]


def options(group):
    return dict(kind=group.kind, start=group.start, end=group.end, separator=group.separator, only_last=group.only_last)


@pytest.mark.parametrize("group", GROUPINGS)
def test_chunks_match_the_sequential_rule(make_lines, group):
    logs = {**random_logs(1), "markers.log": MARKERS_LOG, "separators.log": SEPARATORS_LOG, "plain.log": PLAIN_LOG}
    rows = chunk_lines(make_lines(logs), [RuleSet("rules", grouping=group)], bits=2).collect()
    for name, lines in logs.items():
        expected = sequential.chunks(lines, **options(group))
        got = {}
        for row in sorted((r for r in rows if r.file_path == name), key=lambda r: r.line_no):
            got.setdefault(row.chunk_no, []).append(row)
        assert [[r.line for r in got[k]] for k in sorted(got)] == [body for _, _, body in expected], name
        for k, (offset, first, body) in zip(sorted(got), expected):
            assert [r.pos for r in got[k]] == list(range(len(body)))
            if not group.only_last or group.kind == "separator":
                assert {r.chunk_offset for r in got[k]} == {offset}
            assert got[k][0].line_no == first + 1


@pytest.mark.parametrize("group", GROUPINGS)
@pytest.mark.parametrize("width", [(0, 0, 20), (2, 1, 20), (3, 3, 4), (5, 0, 1), (1, 4, 0)])
def test_findings_match_the_sequential_rule(make_lines, group, width):
    logs = random_logs(2)
    one = RuleSet("rules", errors=(r"\berror\b",), warnings=("warn",), ignores=("noise",), grouping=group)
    check(find_in_lines(make_lines(logs), [one], *width, bits=3), logs, one, width)


@pytest.mark.parametrize("group", GROUPINGS[:3] + GROUPINGS[5:7])
def test_last_run_matches_the_sequential_rule(make_lines, group):
    logs = random_logs(3)
    one = RuleSet("rules", classifier="rsnapshot_basic", errors=("error and",), warnings=("warn",), grouping=group)
    own = [re.compile(p) for p in (group.start, group.end) if p]
    markers = own + [re.compile("^={5,}$"), re.compile("^-{5,}$"), re.compile(r"rsnapshot\s+\w+:\s+started", re.I)]
    check(find_in_lines(make_lines(logs), [one], 2, 1, 20, bits=3), logs, one, (2, 1, 20), markers)


def test_compat_prefix(make_lines, make_bodies):
    logs = random_logs(4)
    one = RuleSet("rules", errors=("error",), grouping=GROUPINGS[1])
    check(find_in_lines(make_lines(logs), [one], 2, 0, 20, compat_prefix=True, bits=3), logs, one, (2, 0, 20), compat=True)


def check(found, logs, one, width, markers=None, compat=False):
    rows = found.collect()
    kind = rules.classifier_of(one)
    for name, lines in logs.items():
        expected = sequential.findings(
            lines, kind.errors + one.errors, kind.warnings + one.warnings, one.ignores, *width, compat=compat,
            markers=markers, **options(one.grouping))
        got = sorted((r.finding_index, r.severity, r.rule_id, r.match_text, r.line_start, r.excerpt)
                     for r in rows if r.file_path == name)
        assert got == sorted(expected), name


def test_both_forms_agree(make_lines, make_bodies):
    logs = random_logs(5)
    sets = [RuleSet("rules", errors=("error", "err"), warnings=("warn", "Warn"), ignores=("noise",))]
    a = find_in_lines(make_lines(logs), sets, 3, 2, 4, bits=2)
    b = find_in_texts(make_bodies(logs), sets, 3, 2, 4)
    names = [c for c in b.columns]
    assert a.count() > 0
    assert a.select(names).exceptAll(b).isEmpty() and b.exceptAll(a.select(names)).isEmpty()


def test_result_does_not_depend_on_blocks_or_staging(make_lines):
    lines = make_lines({"hot.log": ["BEGIN", "error", "x", "END"] * 300, **random_logs(6)})
    sets = [RuleSet("rules", errors=("error",), grouping=GROUPINGS[1])]
    names = ["file_path", "finding_index", "chunk_no", "line_start", "message"]
    base = sorted(find_in_lines(lines, sets, bits=16).select(names).collect())
    for bits, staged in ((1, True), (4, False), (8, True)):
        assert sorted(find_in_lines(lines, sets, bits=bits, staged=staged).select(names).collect()) == base


@pytest.mark.parametrize("rows,size", [(0, 1 << 20), (1000, 10), (1000, 1 << 20)])
def test_only_wanted(spark, monkeypatch, rows, size):
    """The same rows with and without a broadcast; limits hold for rows and for bytes."""
    from logquarry import staging

    monkeypatch.setattr(staging, "ROWS_TO_BROADCAST", rows)
    monkeypatch.setattr(staging, "BYTES_TO_BROADCAST", size)
    table = spark.range(500).selectExpr("concat('f', id % 7) AS file", "id AS no", "id * 2 AS v")
    wanted = spark.range(0, 700, 50).selectExpr("concat('f', id % 7) AS file", "id AS no", "1 AS extra")
    kept = staging.only_wanted(table, ["file", "no"], wanted)
    assert sorted((r.no, r.v) for r in kept.collect()) == [(i, 2 * i) for i in range(0, 500, 50)]


def test_several_rule_sets_in_one_pass(make_lines, spark):
    logs = {"a/backup.log": ["rsnapshot x: started", "ERROR: one", "=====", "ERROR: two"], "b/web.log": ["5xx error"],
            "c/other": ["error", "===", "error"]}
    sets = [RuleSet("sep", r"c/", errors=("error",), grouping=Grouping("separator", separator="===")),
            RuleSet("backup", r"backup.*\.log", classifier="rsnapshot_basic"), RuleSet("web", r"web", warnings=("5xx",))]
    lines = rules.with_routing(make_lines(logs), sets)
    found = find_in_lines(lines, sets).collect()
    assert sorted((r.file_path, r.pipeline_name, r.message, r.line_start) for r in found) == [
        ("a/backup.log", "backup", r"rsnapshot error pattern /\bERROR:/", 4),
        ("b/web.log", "web", 'Matched warning pattern /5xx/ on "5xx"', 1),
        ("c/other", "sep", 'Matched error pattern /error/ on "error"', 1),
        ("c/other", "sep", 'Matched error pattern /error/ on "error"', 2)]


def test_routing_override_and_fallback(spark):
    from pyspark.sql import functions as F

    sets = [RuleSet("one", "aaa"), RuleSet("two", "bbb")]
    df = spark.createDataFrame([("x/bbb",), ("x/aaa-bbb",), ("x/ccc",)], "p string")
    assert [r[0] for r in df.select(rules.route(F.col("p"), sets)).collect()] == ["two", "one", "one"]
    assert [r[0] for r in df.select(rules.route(F.col("p"), sets, "two")).collect()] == ["two"] * 3
    with pytest.raises(ValueError):
        rules.route(F.col("p"), sets, "three")


def test_long_match_and_repeats(make_bodies):
    sets = [RuleSet("rules", errors=("x+",))]
    rows = find_in_texts(make_bodies({"f": ["x" * 130, "xx XX xx", "none"]}), sets).orderBy("finding_index").collect()
    assert rows[0].message == 'Matched error pattern /x+/ on "' + "x" * 117 + '..."'
    assert [(r.line_start, r.match_text) for r in rows[1:]] == [(2, "xx"), (2, "XX"), (2, "xx")]


def test_custom_classifiers(make_bodies, make_lines):
    def shouting(pipeline, lines):
        return [(i, "CRITICAL", f"{pipeline} shouts", "caps") for i, line in enumerate(lines) if line.isupper()]

    rows = custom_chunk_findings(make_bodies({"f": ["a", "B", "c", "D"]}), shouting).collect()
    assert [(r.line_start, r.finding_index, r.excerpt, r.message) for r in sorted(rows)] == [
        (2, 0, ["B"], "rules shouts"), (4, 1, ["D"], "rules shouts")]
    rules.register_classifier("disk", rules.Classifier(errors=("disk full",)))
    found = find_in_lines(make_lines({"f": ["Disk full", "ok"]}), [RuleSet("rules", classifier="disk")]).collect()
    assert [r.line_start for r in found] == [1]


CONFIG = {
    "pipelines": [
        {"name": "cloud", "match": {"filename_regex": r"cloud.*\.log"}, "classifier": {
            "error_regexes": [r'"level"\\s*:\\s*(3|4)'], "warning_regexes": [r'"level"\\s*:\\s*2'],
            "ignore_regexes": [".*Trusted domain error.*"]}, "grouping": "whole_file"},
        {"name": "web", "match": {"filename_regex": r".*access\.log"}, "classifier": {
            "error_regexes": [r'"\\s5\d{2}\\s'], "warning_regexes": [r'"\\s4\d{2}\\s'],
            "ignore_regexes": [r'"\\s404\\s', "(healthcheck|metrics)"]}},
        {"name": "home", "classifier": {"type": "unknown_type", "error_regexes": [r"\berror\b", "Traceback"]},
         "grouping": {"type": "marker_based", "start_regex": "^start"}},
    ],
    "modules": [{"name": "m", "path": "/var/log/x", "mode": "Follow", "llm": {"min_severity": "error", "provider": "p"},
                 "alerts": {"webhook": {"url": "http://x"}, "mqtt": {"host": "h", "topic": "t", "min_severity": "warning"}}}],
}


def test_configured_rules(make_lines):
    sets = read_rule_sets(CONFIG)
    lines = make_lines({
        "cloud1.log": ['{"level":3,"m":"a"}', '{"level": 2}', '{"level":1}', '{"level":4, "x": "Trusted domain error"}'],
        "access.log": ['"GET /" 500 1', '"GET /" 404 1', '"GET /healthcheck" 500 1', '"GET /" 403 1', '"GET /" 200 5'],
        "home.txt": ["an error", "errors", "Traceback (most recent call last):"]})
    found = find_in_lines(rules.with_routing(lines, sets), sets).collect()
    assert sorted((r.file_path, r.line_start, r.severity) for r in found) == [
        ("access.log", 1, "ERROR"), ("access.log", 4, "WARNING"), ("cloud1.log", 1, "ERROR"), ("cloud1.log", 2, "WARNING"),
        ("home.txt", 1, "ERROR"), ("home.txt", 3, "ERROR")]
    module = read_module(CONFIG["modules"][0], {"providers": {"p": {"max_excerpt_lines": 7}}})
    assert read_module(CONFIG["modules"][0], {"providers": {"p": {}}, "max_excerpt_lines": 50}).gate.max_excerpt_lines == 50
    assert module.mode == "follow" and module.gate.max_excerpt_lines == 7 and module.gate.min_severity == "ERROR"
    assert [(c.channel, c.min_severity) for c in module.channels] == [("webhook", "ERROR"), ("mqtt", "WARNING")]


def test_template_of_a_module(tmp_path):
    (tmp_path / "prompt.txt").write_text("{severity:>9}: {reason}")
    item = {"name": "m", "path": "/x", "llm": {"prompt_template": str(tmp_path / "prompt.txt")}}
    assert read_module(item).gate.template == "{severity:>9}: {reason}"
    for wrong in ({"mode": "x"}, {"stale_after_minutes": 0}, {"stale_after_minutes": "soon"}, {"output_format": "xml"},
                  {"llm": {"context_prefix_lines": -1}}, {"llm": {"prompt_template": "/missing"}}):
        with pytest.raises(ValueError, match="module m"):
            read_module({"name": "m", "path": "/x"} | wrong)


@pytest.mark.parametrize("bad", [
    {"name": "p", "grouping": {"type": "unknown"}}, {"name": "p", "classifier": {"error_regexes": ["("]}},
    {"name": "p", "grouping": ["x"]}])
def test_bad_rule_sets_are_refused(bad):
    with pytest.raises(ValueError):
        read_rule_sets({"pipelines": [bad]})


def test_presets(make_bodies):
    errors = tuple(p for _, p, k in rules.PRESET_RULES if k == "error")
    warnings = tuple(p for _, p, k in rules.PRESET_RULES if k == "warning")
    ignores = tuple(p for _, p, k in rules.PRESET_RULES if k == "ignore")
    body = ["GET / 503 x", "slow query", "health check 503 x", "Cache refresh completed in 3ms timeout", "deprecated"]
    rows = find_in_texts(make_bodies({"f": body}), [RuleSet("rules", errors=errors, warnings=warnings, ignores=ignores)])
    assert sorted((r.line_start, r.severity) for r in rows.collect()) == [(1, "ERROR"), (2, "WARNING"), (5, "WARNING")]


def test_excerpts_where_every_line_matches(make_lines):
    """50 lines around each of 400 matches: excerpts are windows of the file, and no row is made for a line of a window."""
    body = [f"error {i}" for i in range(400)]
    sets = [RuleSet("rules", errors=("error",))]
    rows = find_in_lines(make_lines({"dense.log": body}), sets, 50, 50, limit=200).collect()
    assert len(rows) == 400
    for r in rows:
        at = r.physical_line_no - 1
        assert r.excerpt == body[max(0, at - 50):at + 51]

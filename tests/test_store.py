import datetime

import pytest
from pyspark.sql import functions as F

from logquarry.operators import explore, stats, store
from logquarry.schema import FINDINGS
from logquarry.spec import RuleSet

NOW = datetime.datetime(2024, 1, 31, 12, tzinfo=datetime.timezone.utc)


def finding(id, module="m", severity="ERROR", message="boom 1", line=1, hours=1.0, index=None, excerpt=("boom 1",),
            pipeline="p", file="f", rule=None):
    at = None if hours is None else NOW - datetime.timedelta(hours=hours)
    return (id, module, pipeline, file, index if index is not None else id, severity, message, line, line, rule,
            list(excerpt), False, False, None, None, None, None, None, None, at)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, FINDINGS)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def now():
    return F.lit(NOW)


def test_unseen(make):
    stored = make([finding(1), finding(2, severity="WARNING")])
    batch = make([finding(10), finding(12, line=2), finding(11, line=2), finding(13, module="n"),
                  finding(14, severity="WARNING"), finding(15, severity="warning")])
    assert ids(store.unseen(batch, stored)) == [11, 13, 15]


def test_many_copies_of_one_finding(make, spark):
    copies = make([finding(0)]).select(*[c for c in FINDINGS.names if c not in ("id", "finding_index")]).crossJoin(
        spark.range(20000).select("id", F.col("id").alias("finding_index"))).select(*FINDINGS.names)
    assert ids(store.first_of_each(copies, ["finding_index"])) == [0]


def test_retention_limits(make):
    rows = make([finding(1, hours=48), finding(2, hours=48.001), finding(3, hours=None), finding(4)])
    assert ids(store.retained(rows, now(), 2)) == [1, 3, 4]
    assert ids(store.retained(rows, now(), 0)) == [1, 2, 3, 4]


def test_deletes(make, spark):
    rows = make([finding(1), finding(2, module="n"), finding(3, message="Boom", excerpt=("x", "y 42")),
                 finding(4, pipeline="q", message="y 42")])
    assert ids(store.without_modules(rows, ["n"])) == [1, 3, 4]
    assert ids(store.without_ids(rows, spark.range(2, 4))) == [1, 4]
    assert ids(store.without_matches(rows, r"y \d+", "p")) == [1, 2, 4]
    assert ids(store.without_matches(rows, r"y \d+")) == [1, 2]
    assert ids(store.without_matches(rows, r"boom")) == [3]
    assert ids(store.without_matches(rows, "(")) == [1, 2, 3, 4]


def test_false_positive(make):
    rows = make([finding(1, message="disk 17 full"), finding(2, message="disk 99 full"), finding(3, message="other")])
    rules, rest = store.false_positive(rows, RuleSet("p"), 1)
    assert rules.ignores == (r"disk\ \d+\ full",) and ids(rest) == [3]
    rules, rest = store.false_positive(rows, RuleSet("p"), 1, sample="a line not stored 5")
    assert rules.ignores == (r"a\ line\ not\ stored\ \d+",) and ids(rest) == [2, 3]
    rules, rest = store.false_positive(rows, RuleSet("p", ignores=("oth",)), 3, pattern=" oth ")
    assert rules.ignores == ("oth",) and ids(rest) == [1, 2]
    assert ids(store.false_positive(rows, RuleSet("p"), 99)[1]) == [1, 2, 3]


def test_severity_changes(make, spark):
    rows = make([finding(1), finding(2)])
    assert [r.severity for r in store.with_severity(rows, 2, "critical").orderBy("id").collect()] == ["ERROR", "CRITICAL"]
    with pytest.raises(ValueError):
        store.with_severity(rows, 2, "fatal")
    changes = spark.createDataFrame([(1, "Warning"), (2, "nonsense")], "id long, new_severity string")
    assert [r.severity for r in store.with_severities(rows, changes).orderBy("id").collect()] == ["WARNING", "ERROR"]


def test_manual_findings(make, spark):
    stored = make([finding(1, index=4)])
    requests = spark.createDataFrame([
        (1, "m", "f", None, "error", None, ["", "  first ", "x"], [7, 5]),
        (2, "m", "f", "p", "warning", " said ", ["a"], None),
        (3, "m", "f", "p", "fatal", "no", ["a"], None),
        (4, "m", "f", "p", "error", "no", [" ", ""], None),
        (5, "new", "f", "p", "critical", "", ["a", "b"], []),
    ], "request_id long, module_name string, file_path string, pipeline_name string, severity string, message string, "
       "selected array<string>, line_numbers array<bigint>")
    rows = store.manual_findings(requests, stored).orderBy("module_name", "finding_index").collect()
    assert [(r.module_name, r.finding_index, r.message, r.line_start, r.line_end, r.pipeline_name) for r in rows] == [
        ("m", 5, "  first ", 5, 7, ""), ("m", 6, "said", 0, 0, "p"), ("new", 1, "a", 0, 1, "p")]


def test_model_results(make, spark):
    rows = make([finding(1), finding(2), finding(3)])
    results = spark.createDataFrame(
        [(1, "a", "m", "text", None, 3, 4), (2, "a", "m", "ignored", "timeout", 3, 4)],
        "id long, provider string, model string, content string, error string, prompt_tokens long, completion_tokens long")
    merged = {r.id: r for r in store.merge_model_results(rows, results).collect()}
    assert (merged[1].llm_response_content, merged[1].llm_error, merged[1].llm_prompt_tokens) == ("text", None, 3)
    assert (merged[2].llm_response_content, merged[2].llm_error, merged[2].llm_prompt_tokens) == (None, "timeout", None)
    assert merged[3].llm_provider is None


def test_module_stats_window_and_case(make, spark):
    rows = make([finding(1, hours=24), finding(2, hours=24.001), finding(3, severity="warning"), finding(4, severity="INFO"),
                 finding(5, module="gone", severity="CRITICAL")])
    activity = spark.createDataFrame([("m", NOW), ("quiet", None)], "module_name string, mtime timestamp")
    got = {r.module_name: r for r in stats.module_stats(rows, activity, now()).collect()}
    assert (got["m"].errors_24h, got["m"].warnings_24h, got["m"].last_severity) == (1, 1, "INFO")
    assert got["m"].last_log_update == NOW.replace(tzinfo=None)
    assert (got["quiet"].errors_24h, got["quiet"].last_log_update) == (0, None)
    assert got["gone"].errors_24h == 1


def watch(spark, rows):
    return spark.createDataFrame(rows, "name string, enabled boolean, mode string, stale_after_minutes long")


@pytest.mark.parametrize("ages,expected", [
    ((10, 20), ("ok", "Logs updating (within 60m)")),
    ((10, 61), ("warn", "Some modules stale (> 60m)")),
    ((100, 61), ("error", "No recent log updates (> 60m)")),
    ((60, 60), ("ok", "Logs updating (within 60m)")),
    ((None, None), ("error", "No log file activity detected")),
])
def test_freshness(spark, ages, expected):
    activity = spark.createDataFrame(
        [(n, None if a is None else NOW - datetime.timedelta(minutes=a)) for n, a in zip("ab", ages)],
        "module_name string, mtime timestamp")
    modules = watch(spark, [("a", True, "follow", None), ("b", True, "follow", None), ("c", True, "batch", 1),
                            ("d", False, "follow", 1)])
    row = stats.freshness(modules, activity, now()).first()
    assert (row.state, row.message) == expected


def test_freshness_without_watched_modules_and_mixed_windows(spark):
    activity = spark.createDataFrame([("a", NOW), ("b", NOW)], "module_name string, mtime timestamp")
    assert stats.freshness(watch(spark, [("a", True, "batch", None)]), activity, now()).first().message.startswith(
        "Staleness tracking skipped")
    mixed = watch(spark, [("a", True, "follow", 5), ("b", True, "follow", None)])
    assert stats.freshness(mixed, activity, now()).first().message == "Logs updating (within their configured windows)"


def test_notifications(spark):
    none = spark.createDataFrame([], "id long, level string, title string, created_at timestamp")
    assert stats.notification_summary(none).first()[:3] == ("ok", "All systems operational", 0)
    old = [(0, "error", "old", NOW - datetime.timedelta(days=9))]
    rows = [(i, "info", f"t{i}", NOW + datetime.timedelta(seconds=i)) for i in range(1, 201)]
    got = stats.notification_summary(spark.createDataFrame(old + rows, none.schema)).first()
    assert tuple(got) == ("ok", "Info: t200", 200)
    rows[10] = (11, "warning", "w", rows[10][3])
    assert stats.notification_summary(spark.createDataFrame(rows, none.schema)).first().message == "Warnings present: t200"


def test_module_listing(spark):
    modules = watch(spark, [("b", True, "batch", None), ("A", True, "follow", None), ("c", False, "follow", None)])
    assert [r.name for r in stats.ordered_modules(modules).collect()] == ["A", "b", "c"]
    assert [r.name for r in stats.modules_to_run(modules).collect()] == ["A"]
    assert [r.name for r in stats.modules_to_run(modules, "c").collect()] == ["c"]


def test_listings(make):
    rows = make([finding(i, hours=i / 100) for i in range(1, 80)] + [finding(100, module="n")])
    assert ids(stats.recent_findings(rows, 3)) == [1, 2, 3, 100]
    assert [r.id for r in stats.recent_of_module(rows, "m", 2).collect()] == [1, 2]
    assert ids(stats.by_id(rows, 100)) == [100]
    lines = explore.error_lines(rows, limit=5).where("module_name = 'm'").orderBy("line_no").collect()
    assert len(lines) == 5 and lines[0].line == "[ERROR] finding #1 @ 2024-01-31 11:59:24 UTC" and lines[1].line == "boom 1"
    assert explore.without_headers(explore.error_lines(rows, limit=4)).count() == 3


def test_log_view(make, make_lines):
    lines = make_lines({"f": [f"row {i}" for i in range(1, 11)]})
    shown = explore.page(lines, limit=3, offset=2)
    assert sorted((r.line_no, r.start_line, r.total_lines, r.has_more, r.next_offset) for r in shown.collect()) == [
        (6, 6, 10, True, 5), (7, 6, 10, True, 5), (8, 6, 10, True, 5)]
    assert explore.page(lines, limit=3, offset=10).count() == 0
    rows = make([
        finding(1, line=7, hours=5), finding(2, line=7, hours=1, severity="WARNING"), finding(3, line=2),
        finding(4, line=99, excerpt=("a", "hit b", "c"), rule="hit"), finding(5, line=98, excerpt=("a", "b", "c"), rule="no"),
        finding(6, line=97, excerpt=("a",)), finding(7, line=8, severity="INFO")])
    view = explore.log_view(shown, rows, lines, ["hit", "no"])
    got = sorted((r.line_no, r.text, r.on_page, r.id) for r in view.collect())
    assert got == [(2, "row 2", False, 3), (6, "row 6", True, None), (7, "row 7", True, 2), (8, "row 8", True, 7),
                   (98, "b", False, 5), (99, "hit b", False, 4)]
    assert sorted(r.line_no for r in explore.filter_view(view, "warning").collect()) == [7]
    assert sorted(r.line_no for r in explore.filter_view(view, "all", active_only=True).collect()) == [2, 6, 7, 98, 99]
    assert sorted((r.severity, r.first_line) for r in explore.severity_facet(view).collect()) == [
        ("ERROR", 2), ("INFO", 8), ("WARNING", 7)]
    assert explore.displayed_findings(view).first().n_findings == 5
    assert {r.id: r.example for r in explore.line_examples(view).collect()}[4] == "hit b"


def test_stored_pages_read_only_their_parts(spark, make_lines, tmp_path):
    from logquarry.operators import line_store

    read = []
    for n in (100, 1000):
        lines = make_lines({"long 1%.log": [f"row {i}" for i in range(1, n + 1)], "a.log": ["x"], "b.log": [f"y{i}" for i in range(30)]})
        store = line_store.store_lines(lines, str(tmp_path / f"store {n}"), part_lines=20)
        assert line_store.longest_log(spark, store) == "long 1%.log"
        for name in ("long 1%.log", "a.log", "b.log"):
            for limit, offset in ((5, 0), (7, 13), (2000, 0), (3, 1), (5, 5000)):
                page = line_store.stored_page(spark, store, name, limit, offset)
                whole = explore.page(lines.where(f"file_path = '{name}'"), limit, offset)
                assert page.columns == whole.columns
                assert sorted(map(tuple, page.collect())) == sorted(map(tuple, whole.collect()))
        read.append(len(line_store.stored_page(spark, store, "long 1%.log", 5, 40).inputFiles()))
    assert max(read) <= 2
    assert line_store.stored_page(spark, store, "none.log").count() == 0

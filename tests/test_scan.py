import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from logquarry.operators import payloads, store
from logquarry.plans.analyze import analyze, printable
from logquarry.sources import sinks
from logquarry.sources.text_logs import (
    existing_paths, listed_files, missing_path_notifications, scan_documentation, scan_text, unreadable_file_findings)
from logquarry.spec import AlertChannel, ModelGate, Module, RuleSet


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "big.log").write_text("".join(f"line {i} {'x' * (i % 97)}\n" for i in range(1, 6001)))
    (tmp_path / "sub" / "bytes.log").write_bytes(b"a\rb\nc\r\nd \xff\xfe e\n\nlast")
    (tmp_path / "sub" / "small.log").write_text("error one\nfine\nerror two\n")
    (tmp_path / "empty.log").write_text("")
    return tmp_path


def by_file(df):
    out = {}
    for row in df.collect():
        out.setdefault(os.path.basename(row.file_path), []).append((row.line_no, row.line))
    return {name: sorted(rows) for name, rows in out.items()}


@pytest.mark.parametrize("split_bytes", ["4096", "50000", "134217728"])
def test_numbers_do_not_depend_on_splits(spark, folder, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = by_file(scan_text(spark, [str(folder)]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["big.log"] == [(i, f"line {i} {'x' * (i % 97)}") for i in range(1, 6001)]
    assert [line for _, line in got["bytes.log"]] == ["a", "b", "c", "d �� e", "", "last"]
    assert [no for no, _ in got["bytes.log"]] == [1, 2, 3, 4, 5, 6]
    assert "empty.log" not in got and len(got["small.log"]) == 3


def test_missing_and_unreadable(spark, folder):
    found, missing = existing_paths(spark, [str(folder), str(folder / "nowhere")])
    assert found == [str(folder)] and missing == [str(folder / "nowhere")]
    notes = missing_path_notifications(spark, missing).collect()
    assert notes[0].level == "error" and notes[0].detail.endswith("nowhere does not exist")
    files = listed_files(spark, found)
    assert files.count() == 3
    lines = scan_text(spark, found).where(~F.col("file_path").contains("small.log"))
    rows = unreadable_file_findings(files, lines.select("file_path").distinct(), F.lit("p")).collect()
    assert [(os.path.basename(r.file_path), r.severity, r.line_start, r.excerpt) for r in rows] == [
        ("small.log", "ERROR", 1, [])]


def test_paths_with_blanks_and_a_broken_file(spark, tmp_path):
    """Anchored file patterns see the plain path; a file that cannot be read is one finding of its own rule set."""
    folder = tmp_path / "my logs+100%"
    (folder / "a").mkdir(parents=True)
    (folder / "b").mkdir()
    (folder / "a" / "x y.log").write_text("error 1\nfine\n")
    (folder / "b" / "z.log").write_text("fine\nerror 2\n")
    (folder / "b" / "broken.gz").write_bytes(b"this is not compressed")
    sets = [RuleSet("first", "no such file", errors=("nothing",)), RuleSet("a", f"^{re.escape(str(folder))}/a/", errors=("error",)),
            RuleSet("b", f"^{re.escape(str(folder))}/b/", errors=("error",))]
    rows = analyze(spark, [str(folder)], sets, Module("m", str(folder))).collect()
    assert sorted((r.pipeline_name, r.file_path, r.line_start, r.message.split(":")[0][:19]) for r in rows) == [
        ("a", str(folder / "a" / "x y.log"), 1, "Matched error patte"), ("b", str(folder / "b" / "broken.gz"), 1, "failed to read file"),
        ("b", str(folder / "b" / "z.log"), 2, "Matched error patte")]
    named = analyze(spark, [str(folder)], sets, Module("m", str(folder), pipeline="b")).collect()
    assert {r.pipeline_name for r in named} == {"b"} and len(named) == 3
    with pytest.raises(ValueError):
        analyze(spark, [str(folder)], sets, Module("m", str(folder), pipeline="c"))


def test_batch_run_to_sinks(spark, folder, tmp_path):
    os.utime(folder / "sub" / "small.log", (1_700_000_000, 1_700_000_000))
    gate = ModelGate(enabled=True, min_severity="ERROR", context_suffix_lines=1)
    module = Module("m", str(folder), gate=gate, channels=(AlertChannel("m", "webhook", "http://x"),))
    rules = [RuleSet("fallback", "nothing"), RuleSet("small", r"small\.log", errors=("error",), warnings=("fine",))]
    found = analyze(spark, [str(folder), str(folder / "gone")], rules, module)
    rows = sorted(found.collect(), key=lambda r: r.finding_index)
    assert [(r.severity, r.line_start, r.excerpt, r.needs_llm) for r in rows] == [
        ("ERROR", 1, ["error one", "fine"], True), ("WARNING", 2, ["fine", "error two"], False),
        ("ERROR", 3, ["error two"], True)]
    assert {r.created_at.timestamp() for r in rows} == {1_700_000_000}
    assert printable(found, Module("m", "", min_print_severity="ERROR")).count() == 2

    text = sorted(r.value for r in sinks.summary_text(found, "ERROR").collect())
    assert text[0].endswith('small.log [small] finding=0\n  severity: ERROR\n  reason:   Matched error pattern /error/ on '
                            '"error"\n  lines:    1-1\n  needs_llm: True\n')
    records = [json.loads(r.value) for r in sinks.summary_json(found).collect()]
    assert len(records) == 3 and set(records[0]) == {
        "file_path", "pipeline", "finding_index", "severity", "reason", "needs_llm", "line_start", "line_end"}
    sinks.write_text(sinks.summary_json(found), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    alerts = payloads.alert_records(found, list(module.channels)).collect()
    assert sorted(json.loads(a.body)["line_start"] for a in alerts) == [1, 3]
    names = {r.payload_name for r in payloads.with_payload(found, gate).where("payload IS NOT NULL").collect()}
    assert names == {"small_ERROR_finding0.txt", "small_ERROR_finding2.txt"}

    path = str(tmp_path / "store")
    store.append(found, path)
    store.append(found, path)
    stored = store.read(spark, path, ["m"])
    assert stored.count() == 3 and stored.select("id").distinct().count() == 3
    store.append(found.withColumn("message", F.concat("message", F.lit(" again"))).repartition(3), path)
    assert sorted(r.id for r in store.read(spark, path).collect()) == list(range(6))
    everything = store.read(spark, path)
    assert store.removed(everything, store.without_all(everything)).first().n_removed == 6


def test_nothing_to_read(spark, tmp_path):
    assert analyze(spark, [str(tmp_path / "gone")], [RuleSet("r")], Module("m", "x")).count() == 0


def test_documentation_files(spark, tmp_path):
    for name, text in {"a.md": "x\xe9", "docs/b.rst": "y", "docs/.hidden/c.md": "z", ".git/d.md": "q", "e.py": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode() + b"\xff")
    rows = scan_documentation(spark, str(tmp_path), "r", "c").collect()
    assert sorted((os.path.relpath(r.file_path, tmp_path), r.content) for r in rows) == [("a.md", "x\xe9"), ("docs/b.rst", "y")]
    assert scan_documentation(spark, str(tmp_path), "r", "c", ["docs/*.md", "*.md"]).count() == 1


def test_files_of_one_text_each_lie_in_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    """doc_scan and batch_run: no folder that one listing reads holds a folder for every text."""
    from logquarry.plans import document_queries, log_queries
    from logquarry.sources import tables

    monkeypatch.setattr(tables, "FILE_FOLDERS", 5)
    rows = [(i, "s", "en", f"fine {i}\napache license") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    for module in (document_queries, log_queries):
        monkeypatch.setattr(module, "new_folder", lambda _, name: made.append(tmp_path / name) or f"file:{tmp_path / name}")
    assert sorted(r.doc_id for r in document_queries.doc_scan(spark, str(tmp_path)).collect()) == list(range(60))
    assert {r.doc_id for r in log_queries.batch_run(spark, str(tmp_path)).collect()} <= set(range(60))
    docs, batch = made
    assert len([d for d in docs.iterdir() if d.is_dir()]) <= 5
    for kind in (d for d in batch.iterdir() if d.is_dir()):
        assert len([d for d in kind.iterdir() if d.is_dir()]) <= 5


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
@pytest.mark.parametrize("local", [True, False])
def test_files_of_one_text_each(spark, tmp_path, monkeypatch, scheme, local):
    """doc_scan and batch_run write one file for each text, in local folders nothing beside it, and find all of them however the
    folder is named."""
    from logquarry.plans import document_queries, log_queries

    texts = {i: f"fine {i}\napache license" for i in range(40)} | {40: "", 41: None, 42: "\xe9 \U0001f600\r\n\nlicense\t"}
    spark.createDataFrame([(i, "s", "en", t) for i, t in texts.items()], "doc_id long, source string, lang string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    for module in (document_queries, log_queries):
        monkeypatch.setattr(module, "new_folder", lambda _, name: f"{scheme}{tmp_path / name}")
    if not local:
        monkeypatch.setattr(sinks, "local_path", lambda *_: None)
    docs = document_queries.doc_scan(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_chars) for r in docs} == {(i, len(t or "") + 1) for i, t in texts.items()} and len(docs) == len(texts)
    found = log_queries.batch_run(spark, str(tmp_path)).collect()
    errors = sorted((r.doc_id, r.pipeline_name, r.line_start, r.excerpt) for r in found if r.severity == "ERROR")
    assert errors == sorted((i, "web" if i % 3 else "mail", 3 if i == 42 else 2, "license\t" if i == 42 else "apache license")
                            for i, t in texts.items() if t and "license" in t)
    if local:
        files = [f for f in (tmp_path / "docs").rglob("*") if f.is_file()]
        assert len(files) == len(texts) and len({f.parent for f in files}) <= 256
        assert {f.read_bytes() for f in files} == {((t or "") + "\n").encode() for t in texts.values()}


def test_rows_of_one_file_are_lines_of_it(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1, "x"), ("a/b", 2, "y"), ("a b", 1, "z"), (None, 3, "w")], "kind string, log long, value string")
    sinks.write_files(rows.coalesce(1), str(tmp_path / "t"), ["kind"], "log")
    sinks.write_files(rows.limit(0), str(tmp_path / "none"), ["kind"], "log")
    files = {f.relative_to(tmp_path / "t").as_posix(): f.read_text() for f in (tmp_path / "t").rglob("*") if f.is_file()}
    assert files == {"kind=a b/log=1.00000.txt": "x\nz\n", "kind=a%2Fb/log=2.00000.txt": "y\n",
                     "kind=__HIVE_DEFAULT_PARTITION__/log=3.00000.txt": "w\n"}
    assert (tmp_path / "none").is_dir() and scan_text(spark, [str(tmp_path / "none")]).count() == 0


def test_tasks_take_several_splits(spark, tmp_path, monkeypatch):
    """Many small files are read by few tasks; lines keep their numbers."""
    from logquarry.sources import tables

    for i in range(100):
        (tmp_path / f"{i}.log").write_text("".join(f"{i} {j}\n" for j in range(i)))
    assert scan_text(spark, [str(tmp_path)]).rdd.getNumPartitions() > 3
    monkeypatch.setattr(tables, "SPLITS_A_CORE", 0)
    monkeypatch.setattr(tables, "SPLITS_A_TASK", 3)
    lines = scan_text(spark, [str(tmp_path)])
    assert lines.rdd.getNumPartitions() <= 3
    assert sorted((r.line, r.line_no) for r in lines.collect()) == sorted((f"{i} {j}", j + 1) for i in range(100) for j in range(i))
    assert listed_files(spark, [str(tmp_path)]).rdd.getNumPartitions() <= 3
    assert scan_documentation(spark, str(tmp_path), "r", "c", ["*.log"]).rdd.getNumPartitions() <= 3

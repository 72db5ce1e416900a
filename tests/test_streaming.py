import datetime
import time

from pyspark.sql import functions as F

from logquarry.operators import store
from logquarry.operators.classify import find_in_lines
from logquarry.spec import AlertChannel, ModelGate, Module, RuleSet
from logquarry.streaming import follow

RULES = [RuleSet("rules", errors=("error",), warnings=("warn",), ignores=("noise",))]
LOG = ["one", "error a", "warn b", "noise error", "x", "error c error d", "tail", "warn", "error e"]


def land(folder, module, generation, segment, lines):
    path = folder / module / str(generation)
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{segment}.log").write_text("\n".join(lines) + "\n")
    time.sleep(0.02)


def run(stream, tmp_path, name="out", **options):
    """Findings of what has arrived; a second run goes on from the first."""
    out = str(tmp_path / name)
    work = follow.following(RULES, f"{out}-places", follow.as_table(out), **options)
    return follow.run_batches(stream, work, out, f"{out}-checkpoint")


def test_pieces_equal_batch(spark, tmp_path, make_lines):
    landing = tmp_path / "landing"
    for i, (a, b) in enumerate([(0, 2), (2, 3), (3, 6), (6, 9)]):
        land(landing, "m", 0, i, LOG[a:b])
        land(landing, "n", 0, i, LOG[::-1][a:b])
    found = run(follow.text_segments(spark, str(landing), "rules", 2), tmp_path, prefix=2)
    got = sorted((r.module_name, r.finding_index, r.line_start, r.message, r.excerpt) for r in found.collect())
    batch = find_in_lines(make_lines({"m": LOG, "n": LOG[::-1]}), RULES, prefix=2)
    assert got == sorted((r.module_name, r.finding_index, r.line_start, r.message, r.excerpt) for r in batch.collect())


def test_state_survives_a_restart_and_a_new_generation(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "m", 0, 0, ["a", "error 1"])

    def again():
        found = run(follow.text_segments(spark, str(landing), "rules"), tmp_path, prefix=1)
        return sorted((r.finding_index, r.line_start, r.excerpt) for r in found.collect())

    assert again() == [(0, 2, ["a", "error 1"])]
    land(landing, "m", 0, 1, ["error 2"])
    land(landing, "m", 1, 0, ["error 3"])
    assert again() == [(0, 2, ["a", "error 1"]), (1, 3, ["error 1", "error 2"]), (2, 1, ["error 2", "error 3"])]


def test_from_now_on_and_seeded_numbers(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "m", 0, 0, ["error old", "x"])
    time.sleep(1.1)
    started = datetime.datetime.now(datetime.timezone.utc)
    time.sleep(0.1)
    land(landing, "m", 0, 1, ["error new"])
    seeds = spark.createDataFrame([("m", 40)], "module string, next_index long")
    found = run(follow.text_segments(spark, str(landing), "rules"), tmp_path, started=F.lit(started), seeds=seeds)
    assert [(r.finding_index, r.line_start, r.message) for r in found.collect()] == [
        (40, 3, 'Matched error pattern /error/ on "error"')]


def test_delivery_twice_stores_once(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "m", 0, 0, ["error 1", "warn 2"])
    module = Module("m", str(landing), gate=ModelGate(enabled=True, min_severity="ERROR"),
                    channels=(AlertChannel("m", "webhook", "http://x"),))
    action = follow.deliver(module, str(tmp_path / "store"), str(tmp_path / "payloads"), str(tmp_path / "alerts"))
    stream = follow.text_segments(spark, str(landing), "rules")
    for attempt in ("a", "b"):
        work = follow.following(RULES, str(tmp_path / f"places-{attempt}"), action)
        (stream.writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / attempt))
         .trigger(availableNow=True).start().awaitTermination())
    stored = store.read(spark, str(tmp_path / "store")).orderBy("line_start").collect()
    assert [(r.line_start, r.severity, r.needs_llm) for r in stored] == [(1, "ERROR", True), (2, "WARNING", False)]
    assert spark.read.parquet(str(tmp_path / "payloads")).count() == 1
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1


def landed_rows(spark, tmp_path, deliveries):
    """Segments (module, path, pipeline, generation, segment, lines), a file for each delivery, a minute apart."""
    landing = str(tmp_path / "landing")
    for i, rows in enumerate(deliveries):
        arrived = datetime.datetime(2024, 1, 1, 0, i)
        spark.createDataFrame(
            [(*row[:5], arrived, "\n".join(row[5]) + "\n") for row in rows], follow.SEGMENTS).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(0.02)
    return follow.table_segments(spark, landing, 1)


def sequential(deliveries, prefix, forget=None):
    """The places of segments that come one after the other."""
    known, index, out = {}, {}, []
    for at, rows in enumerate(deliveries):
        for module, path, _, generation, segment, lines in sorted(rows):
            log = {g: v for (m, p, g), v in known.items() if (m, p) == (module, path)}
            older = [g for g in log if g < generation]
            line, carried, _ = log.get(generation, (1, log[max(older)][1] if older else [], 0))
            out.append((path, generation, segment, line, index.get(module, 0), carried))
            known[module, path, generation] = (line + len(lines), (carried + lines)[-prefix:], at)
            index[module] = index.get(module, 0) + sum("error" in x for x in lines)
        if forget is not None:
            known = {k: v for k, v in known.items() if v[2] >= at - forget}
    return sorted(out)


def test_late_segments_of_many_generations(spark, tmp_path):
    """Five generations, of which the first ones get late segments; lines of short segments add up to what is carried."""
    deliveries = [
        [("m", "/a.log", "rules", g, s, [f"g{g} s{s} l{i}" for i in range(1 + (g + s) % 3)] + ["error"] * (s % 2)) for g, s in order]
        for order in ([(0, 0), (1, 0)], [(2, 0), (0, 1)], [(3, 0), (1, 1), (4, 0)], [(0, 2), (0, 3), (2, 1), (5, 0)])]
    stream = landed_rows(spark, tmp_path, deliveries)
    rules = [RuleSet("rules", errors=("error",))]

    def places(name, stream, **options):
        out = str(tmp_path / name)
        work = follow.numbering(rules, f"{out}-places", follow.as_table(out), prefix=4, **options)
        rows = follow.run_batches(stream, work, out, f"{out}-checkpoint").collect()
        return sorted((r.file_path, r.generation, r.segment, r.start_line, r.first_index, r.carried) for r in rows)

    assert places("all", stream) == sequential(deliveries, 4)
    assert places("some", stream, forget="30 seconds") == sequential(deliveries, 4, 0.5) != sequential(deliveries, 4)
    # All in one delivery: numbered by generation and segment.
    assert places("once", follow.table_segments(spark, str(tmp_path / "landing"))) == sequential([sum(deliveries, [])], 4)


def test_a_silence_is_told_once(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    landing, out, told = str(tmp_path / "landing"), str(tmp_path / "told"), []
    deliveries = [[("a", 0), ("b", 0)], [("b", 4)], [("b", 9)], [("b", 11)], [("a", 12), ("a", 3)], [("b", 30)]]
    for n, arrivals in enumerate(deliveries):
        spark.createDataFrame([(m, f"/{m}.log", "rules", 0, n, at(t), "x\n") for m, t in arrivals], follow.SEGMENTS).coalesce(1).write.mode(
            "append").parquet(landing)
        work = follow.watching(f"{out}-places", follow.as_table(out), 5)
        rows = follow.run_batches(follow.table_segments(spark, landing), work, out, f"{out}-checkpoint")
        told.append(sorted((r.module, r.silent_since.minute, r.alarm_at.minute) for r in rows.collect()))
    assert told == [[], [], [("a", 0, 5)], [("a", 0, 5)], [("a", 0, 5), ("a", 3, 8)], [("a", 0, 5), ("a", 3, 8), ("a", 12, 17), ("b", 11, 16)]]


def test_two_logs_of_one_module(spark, tmp_path):
    """Each log and generation has its own line numbers and carried lines; finding numbers go on over the module."""
    rows = [("m", "/a.log", "rules", 0, 0, ["a", "error 1"]), ("m", "/b.log", "rules", 0, 0, ["error 2", "b"]),
            ("m", "/a.log", "rules", 0, 1, ["error 3"]), ("m", "/b.log", "rules", 1, 0, ["error 4"]),
            ("m", "/b.log", "rules", 0, 1, ["error late"])]
    found = run(landed_rows(spark, tmp_path, [[r] for r in rows]), tmp_path, prefix=1)
    assert sorted((r.finding_index, r.file_path, r.line_start, tuple(r.excerpt)) for r in found.collect()) == [
        (0, "/a.log", 2, ("a", "error 1")), (1, "/b.log", 1, ("error 2",)), (2, "/a.log", 3, ("error 1", "error 3")),
        (3, "/b.log", 1, ("b", "error 4")), (4, "/b.log", 3, ("b", "error late"))]


def test_texts_without_a_hit_are_not_moved(spark, tmp_path):
    """Only segments with a hit come back for findings, numbered and with carried lines as among all."""
    from datetime import datetime

    from logquarry.streaming.places import Places

    texts = ["one\ntwo", "an error\nfour", "five", "six\nerror\nerror", ""]
    rows = [("m", log, "p", 0, i, datetime(2024, 1, 1, 0, i), text) for log in ("a.log", "b.log") for i, text in enumerate(texts)]
    batch = spark.createDataFrame(rows, follow.SEGMENTS)
    rules = [RuleSet("p", errors=("error",))]
    columns = ["file_path", "segment", "start_line", "first_index", "carried", "text", "pipeline"]

    def numbered(name, **options):
        found = Places(spark, str(tmp_path / name), 2).number(batch, 0, rules, **options).select(*columns).collect()
        return sorted(map(tuple, found))

    every, hit = numbered("every"), numbered("hit", hits_only=True)
    assert len(every) == 10 and hit == [r for r in every if "error" in r[5]]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in hit] == [
        ("a.log", 1, 3, 0, ["one", "two"]), ("a.log", 3, 6, 1, ["four", "five"]),
        ("b.log", 1, 3, 3, ["one", "two"]), ("b.log", 3, 6, 4, ["four", "five"])]

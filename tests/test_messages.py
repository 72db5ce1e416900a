import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logquarry.operators import budget, conversation, payloads
from logquarry.spec import AlertChannel, ModelGate

SCHEMA = "conv_id long, turn long, role string, text string"


# Conversations and what becomes of them.
CONVERSATIONS = {
    "plain": ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
    "same role twice": ([("user", "a "), ("user", " b"), ("assistant", "c")], [("user", "a\n\nb"), ("assistant", "c")]),
    "blank texts": ([("user", "a"), ("assistant", "  "), ("assistant", None), ("user", "b")], [("user", "a\n\nb")]),
    "unknown role": ([("tool", "a"), (None, "b"), ("ASSISTANT ", "c")], [("user", "a\n\nb"), ("assistant", "c")]),
    "several system texts": ([("system", "s"), ("user", "a"), ("system", "t"), ("assistant", "b")], [("user", "s\n\nt\n\na"), ("assistant", "b")]),
    "assistant first": ([("assistant", "a "), ("user", " b"), ("assistant", "c")], [("user", "a\n\nb"), ("assistant", "c")]),
    "assistant only": ([("assistant", " a ")], [("user", " a ")]),
    "system, then assistant": ([("system", "s"), ("assistant", "a"), ("user", "b")], [("user", "s"), ("assistant", "a"), ("user", "b")]),
    "only system": ([("system", "s"), ("system", "t")], [("user", "s\n\nt")]),
    "nothing": ([("user", " ")], []),
}


def alternated(spark, talks, bits):
    names = sorted(talks)
    rows = [(c, t, role, text) for c, name in enumerate(names) for t, (role, text) in enumerate(talks[name])]
    got = {name: [] for name in names}
    for r in conversation.alternate(spark.createDataFrame(rows, SCHEMA), bits=bits).orderBy("conv_id", "first_turn").collect():
        got[names[r.conv_id]].append((r.role, r.content))
    return got


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_alternation(spark, bits):
    assert alternated(spark, {n: talk for n, (talk, _) in CONVERSATIONS.items()}, bits) == {n: out for n, (_, out) in CONVERSATIONS.items()}


@pytest.mark.parametrize("bits", [1, 16])
def test_alternation_keeps_every_text(spark, bits):
    """Roles alternate from the user on, and each text that is not blank is in the result once, system texts first."""
    rnd = random.Random(bits)
    talks = {f"{c:03}": [(rnd.choice(["user", "assistant", "system", "tool", None, " USER "]), rnd.choice([f"t{i}", f" t{i} ", "", None]))
                         for i in range(rnd.randint(1, 40))] for c in range(60)}
    for name, messages in alternated(spark, talks, bits).items():
        assert [role for role, _ in messages] == ["user", "assistant"] * (len(messages) // 2) + ["user"] * (len(messages) % 2)
        said = [text.strip() for role, text in talks[name] if (text or "").strip() and role != "system"]
        told = [text.strip() for role, text in talks[name] if (text or "").strip() and role == "system"]
        assert " ".join(content for _, content in messages).split() == told + said


def test_system_split_and_tokens(spark):
    rows = [(1, 0, "system", "a"), (1, 1, "user", "hello"), (1, 2, "system", "b"), (1, 3, None, "x"), (2, 0, "user", "abc")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.conv_id, r.turn, r.role or "", r.text) for r in conversation.split_system(df).collect())
    assert got == [(1, 1, "user", "hello"), (1, 2, "system", "b"), (1, 3, "", "x"), (2, 0, "user", "abc")]
    tokens = {r.conv_id: r.estimated_tokens for r in conversation.conversation_tokens(df, 10).collect()}
    assert tokens == {1: 12, 2: 10}


def sequential_admission(requests, hourly, daily):
    used, out = defaultdict(list), {}
    for provider, rid, at, estimated, spent in sorted(requests, key=lambda r: (r[2], r[1])):
        log = used[provider]

        def within(window):
            return sum(tokens for when, tokens in log if when >= at - window)

        ok = (provider not in hourly or within(budget.HOUR) + estimated <= hourly[provider]) and (
            provider not in daily or within(budget.DAY) + estimated <= daily[provider])
        out[rid] = ok
        if ok:
            log.append((at, spent or estimated))
    return out


@pytest.mark.parametrize("seed,span_hours", [(1, 400), (2, 60), (3, 3000)])
def test_admission(spark, seed, span_hours):
    rnd = random.Random(seed)
    step = budget.HOUR // 4
    rows = [(rnd.choice("aaabc"), i, rnd.randint(0, span_hours * 4) * step, rnd.randint(1, 100), rnd.choice([0, 50, 90]))
            for i in range(600)]
    hourly, daily = {"a": 150, "c": 60}, {"a": 900, "b": 400}
    df = spark.createDataFrame(rows, "provider string, request_id long, at_us long, estimated long, used long")
    got = {r.request_id: r.admitted for r in budget.admit(df, hourly, daily).collect()}
    expected = sequential_admission(rows, hourly, daily)
    assert got == expected
    assert 0 < sum(expected.values()) < len(rows)


def test_admission_on_a_stream(spark, tmp_path):
    from logquarry.streaming.follow import run_available

    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i, i * budget.HOUR // 3, rnd.randint(1, 100), rnd.choice([0, 50])) for i in range(200)]
    hourly, daily = {"a": 120}, {"a": 900, "b": 700}
    schema = "provider string, request_id long, at_us long, estimated long, used long"
    for part in range(4):
        spark.createDataFrame(rows[part * 50:part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    decided = run_available(budget.admit_stream(stream, hourly, daily), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.request_id: r.admitted for r in decided.collect()} == sequential_admission(rows, hourly, daily)


def test_rolling_usage(spark):
    rnd = random.Random(5)
    rows = [("p" if i % 3 else "q", rnd.randint(0, 5 * budget.DAY // 1000) * 1000, rnd.randint(1, 9)) for i in range(800)]
    rows += [("p", rows[0][1], 4)]
    df = spark.createDataFrame(rows, "provider string, at_us long, tokens long")
    got = budget.rolling_usage(df, {"hour": budget.HOUR, "day": budget.DAY}).collect()
    for r in got:
        for name, window in (("hour", budget.HOUR), ("day", budget.DAY)):
            assert r[name] == sum(t for p, at, t in rows if p == r.provider and r.at_us - window <= at <= r.at_us)


def one_finding(spark, severity="ERROR", excerpt=("plain", "it FAILED", "ok"), needs=True):
    schema = ("module_name string, pipeline_name string, file_path string, finding_index long, severity string, message string, "
              "line_start long, line_end long, excerpt array<string>, needs_llm boolean")
    return spark.createDataFrame([("m", "p", "/f.log", 3, severity, "why", 4, 5, list(excerpt), needs)], schema)


def test_payload_texts(spark):
    plain = payloads.with_payload(one_finding(spark), ModelGate()).first()
    assert plain.payload.startswith("You are analyzing log output from pipeline 'p'.\nRule-based severity: ERROR\nReason: why\n"
                                    "File: /f.log\nLine span: 4-5\n\nProvide an operator-ready summary")
    assert plain.payload.endswith("\n----- BEGIN LOG CHUNK -----\nit FAILED\n----- END LOG CHUNK -----\n")
    assert plain.payload_name == "p_ERROR_finding3.txt"
    whole = payloads.with_payload(one_finding(spark, excerpt=("a", "b")), ModelGate(template="{line_count} {{x}} {reason}"))
    assert whole.first().payload == "2 {x} why\n----- BEGIN LOG CHUNK -----\na\nb\n----- END LOG CHUNK -----\n"
    fallback = payloads.with_payload(one_finding(spark), ModelGate(template="{error_count}")).first().payload
    assert "Write a concise, human-readable briefing" in fallback
    laid_out = payloads.with_payload(one_finding(spark), ModelGate(template="{severity:*^9}|{reason:>5.2}|{line_count:3}|{file_path!s:<8}|"))
    assert laid_out.first().payload.startswith("**ERROR**|   wh|  1|/f.log  |\n")
    for other in ("{severity:,}", "{line_count:s}", "{severity!r}", "{severity:d}", "{line_count:03}"):
        text = payloads.with_payload(one_finding(spark), ModelGate(template=other)).first().payload
        assert "Write a concise, human-readable briefing" in text
    counted = payloads.with_payload(one_finding(spark), ModelGate(template="{error_count}"), extra_counts=True)
    assert counted.first().payload.startswith("1\n-----")
    assert payloads.with_payload(one_finding(spark, needs=False), ModelGate()).first().payload is None
    documented = payloads.with_payload(one_finding(spark).withColumn("docs", F.lit("DOCS")), ModelGate(), context="docs")
    assert documented.first().payload.endswith("DOCS")


@pytest.mark.parametrize("gate,expected", [
    (ModelGate(False), [False] * 4), (ModelGate(True, "WARNING", 2), [True, True, False, False]),
    (ModelGate(True, "ERROR", 3), [False, True, True, False])])
def test_gate(spark, gate, expected):
    rows = spark.createDataFrame([(0, 1, ["a"]), (1, 2, ["a", "b"]), (2, 3, ["a"] * 3), (3, 3, [])],
                                 "i int, rank int, excerpt array<string>").orderBy("i")
    assert [r[0] for r in rows.select(payloads.needs_model(gate, F.col("rank"), F.col("excerpt"))).collect()] == expected


def test_alerts(spark):
    channels = [AlertChannel("m", "mqtt", "t", "WARNING"), AlertChannel("m", "webhook", "u"), AlertChannel("n", "mqtt", "v"),
                AlertChannel("m", "off", "w", "WARNING", enabled=False)]
    assert {r.channel for r in payloads.alert_records(one_finding(spark), channels).collect()} == {"mqtt", "webhook"}
    assert {r.channel for r in payloads.alert_records(one_finding(spark, "WARNING"), channels).collect()} == {"mqtt"}
    assert payloads.alert_records(one_finding(spark), []).count() == 0
    body = json.loads(payloads.alert_records(one_finding(spark), channels).first().body)
    assert body == {"module": "m", "file_path": "/f.log", "pipeline": "p", "severity": "ERROR", "reason": "why",
                    "line_start": 4, "line_end": 5}


def test_provider_choice(spark):
    modules = spark.createDataFrame(
        [("a", True, "x", None), ("b", True, None, 7), ("c", False, "x", None)],
        "name string, llm_enabled boolean, provider_name string, max_output_tokens long")
    schema = "provider string, api_base string, model string, provider_max_tokens long"
    two = spark.createDataFrame([("x", "u", "m", 0), ("y", "u", "m", 99)], schema)
    one = two.where("provider = 'x'")

    def choice(providers, default):
        return {r.name: (r.provider, r.max_tokens) for r in payloads.route_providers(modules, providers, default).collect()}

    assert choice(two, "y") == {"a": ("x", 512), "b": ("y", 7), "c": (None, None)}
    assert choice(one, None) == {"a": ("x", 512), "b": ("x", 7), "c": (None, None)}
    assert choice(two, None)["b"] == (None, None)
    with pytest.raises(Exception, match="Unknown provider"):
        choice(two.where("provider = 'y'"), "y")


def test_chat_request_and_response(spark):
    rows = spark.createDataFrame(
        [("http://x/vLLM", "m", "text", True), ("http://x", "m", "text", False)],
        "api_base string, model string, payload string, cited boolean").withColumns(
        {"temperature": F.lit(0.5), "top_p": F.lit(1.0), "max_tokens": F.lit(9)})
    bodies = [json.loads(r.request) for r in payloads.chat_request(rows).collect()]
    assert [m["role"] for m in bodies[0]["messages"]] == ["user"]
    assert bodies[0]["messages"][0]["content"].endswith("in brackets. Include citations in your response.\n\ntext")
    assert [m["role"] for m in bodies[1]["messages"]] == ["system", "user"] and bodies[1]["max_tokens"] == 9
    answers = spark.createDataFrame([
        ('{"model":"a","choices":[{"message":{"role":"assistant","content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}',),
        ('{"content":[{"type":"text","text":"x"},{"type":"tool"},{"type":"text","text":"y"}],"usage":{"input_tokens":5}}',),
    ], "response string")
    got = [(r.llm_model, r.llm_response_content, r.llm_prompt_tokens, r.llm_completion_tokens)
           for r in payloads.parse_response(answers, "default").collect()]
    assert got == [("a", "hi", 3, 4), ("default", "xy", 5, None)]

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.common_rows import empty, odd, texts
from logquarry.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def expected(text):
    found = [(m.start(), n, m.end()) for n, (kind, pattern) in enumerate(PATTERNS.items())
             for m in re.finditer(pattern, text or "") if right(kind, m[0])]
    return sorted(found)


CASES = [
    "mail a.b@c.de, x@y, x@y.z.w. é@é.de q@w.e1-2", "a@b.c+x@d.e +x@d.e.", "a@b@c.de @x.y a..b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "12 4111111111111111", "x4111111111111111y 41111111111111111111",
    "+1 (171) 555-2028 +49 30 1234567890 +1 2 +12345678901234567 ++1 171 555 20282", "+1     x +1 ( ( 171.555.2028-", "😀 a@b.cd 😀 +1 171 555 2028 é 10.0.0.1",
    "", None, "00000000000000", "7086638319846192 4952935900253052", "1.2.3.4@5.6 +1.2.3.4.5.6.7.8.9.10",
]


def base(spark, docs):
    rows = pii.find(docs, {}, ["doc_id"]).select("doc_id", F.col("base").alias("b")).collect()
    return {r["doc_id"]: [tuple(x) for x in r["b"]] for r in rows}


def test_base_spans(spark):
    found = base(spark, texts(spark, CASES))
    for i, text in enumerate(CASES):
        assert found[i] == expected(text), text


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = base(spark, docs)
    assert found == {r["doc_id"]: expected(r["text"]) for r in docs.select("doc_id", "text").collect()}


def test_query(spark):
    from logquarry.llm.catalog import QUERIES
    docs = {r["doc_id"]: expected(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = docs[r["doc_id"]]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert {x for x in text.split(",") if x} <= set(r["spans"].split(","))


def test_learned_candidates(spark):
    """Trees trained on the given documents find numbers and addresses in other formats and leave dates and amounts."""
    model = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    docs = texts(spark, ["call (171) 555-2028 now", "on 12-04-2024 or 2024/12/04", "write joe.17 [at] mail6 [dot] example [dot] com", "cats (at) home"])
    rows = {r["doc_id"]: r["s"] for r in pii.find(docs, model, ["doc_id"]).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert rows[0] == "phone:5:19" and rows[1] == "" and rows[2].startswith("email:6:") and rows[3] == ""
    assert pii.redact(docs, model, ["doc_id"]).where("doc_id = 0").first()["redacted"] == "call [phone] now"


def test_boosting_holds_out():
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(600, 3))
    truth = (rows[:, 0] > 0.2) & (rows[:, 1] < 0.5)
    model = pii.fit(rows, truth)
    more = draw.normal(size=(600, 3))
    chosen = model.score(more) >= model.threshold
    assert ((more[chosen][:, 0] > 0.1) & (more[chosen][:, 1] < 0.6)).mean() > 0.97 and chosen.sum() > 100
    assert pii.fit(rows, np.ones(600, bool)) is None


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    assert pii.find(docs, pii.learn(docs), ["doc_id", "kept"]).count() == docs.count()
    assert pii.redact(docs, {}, ["doc_id"]).where("doc_id = 1").select("redacted").collect() in ([], [(None,)])

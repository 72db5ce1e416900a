import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.common_rows import empty, odd, texts
from logquarry.llm import quality


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_counts_of_generated_texts():
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice(["a ", "b ", "c\n", "é|", " ", "\n", "#x ", "a b a b c d e f "]) for _ in range(draw.randint(0, 60)))
        assert quality.counts_of(text)[:5] == slow_counts(text)
    assert quality.counts_of(None)[:5] == (0, 0, 0, 0, 0)
    assert quality.counts_of("a b c d e f g h")[4] == 0 and quality.counts_of("a " * 9)[4] == 9


def test_query(spark):
    from logquarry.llm.catalog import QUERIES
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_rules"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = slow_counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS[:5]) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    good = [r for r in rows if marks.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in rows if marks.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_held_out_accuracy(spark):
    """Rules learned on half of the labelled documents judge the other half."""
    folder = "/root/testdata/sf0.1"
    values, bad = quality.examples(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    half = np.arange(len(bad)) % 2 == 0
    rules = quality.learn({k: v[half] for k, v in values.items()}, bad[half])
    rest = {k: v[~half] for k, v in values.items()}
    hit = np.zeros((~half).sum(), bool)
    for rule in rules:
        hit |= quality.covered(rule, rest, len(hit))
    truth = bad[~half]
    assert (hit & ~truth).sum() <= 0.005 * (~truth).sum() and (hit & truth).sum() >= 0.9 * truth.sum()


def test_rules_are_ordered_expressions(spark):
    rules = [[quality.Test("x", True, 3.0), quality.Test("y", False, 1.0)], [quality.Test("y", True, 8.0)]]
    rows = spark.createDataFrame([(4.0, 0.0), (4.0, 2.0), (0.0, 9.0), (3.0, 1.0)], "x double, y double")
    kept = rows.select(quality.verdict(rules, {"x": F.col("x"), "y": F.col("y")})).collect()
    assert [r[0] for r in kept] == [False, True, False, True]


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    marks = spark.createDataFrame([(1, 0), (None, 1), (4, None), (4, 1), (4, 0)], "doc_id long, quality int")
    for m in (marks, marks.limit(0)):
        rows = quality.judged(docs, m, ["doc_id", "text"]).collect()
        assert len(rows) == docs.count() and all(tuple(r["__counts"])[:5] == slow_counts(r["text"]) for r in rows)
    assert texts(spark, []).count() == 0

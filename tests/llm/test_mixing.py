import pytest
from pyspark.sql import functions as F

from llm.common_rows import empty, odd
from logquarry.llm import mixing


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeating the rule: share out, hold those above their limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return held | {s: level * weight[s] for s in open_}
        held |= {s: most * sizes[s] for s in over}
        left -= sum(held[s] for s in over)
        open_ -= over
    return held


def check(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = shares(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert target[s] - 1 <= taken[s] <= target[s]


@pytest.mark.parametrize("block_rows", [None, 3])
def test_given_tables(spark, block_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs).collect()
    check(first)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(first) == docs.count()


def test_few_rows(spark):
    words = [("a", 10), ("a", 30), ("b", 5), ("c", 0), (None, 100), ("d", 1000), ("e", 7), ("f", 3)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(words)], "doc_id long, text string, source string")
    check(mixing.mix(docs).collect())


def test_stream_is_fair_throughout(spark):
    """At every point of the stream a source has had its share, give or take its longest document."""
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i * 7 % 23), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    rows = sorted(mixing.stream(sized, block_rows=20).collect(), key=lambda r: r["mix_start"])
    total = sum(r["words"] for r in rows)
    goal = {r["source"]: r["target"] / total for r in rows}
    had, at = dict.fromkeys("abc", 0), 0
    for r in rows:
        assert r["mix_start"] == at
        at += r["words"]
        had[r["source"]] += r["words"]
        assert all(abs(had[s] - at * goal[s]) <= 3 * 23 for s in had)
    assert abs(at - 1.5 * sized.agg(F.sum("size")).first()[0]) <= 3


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows)

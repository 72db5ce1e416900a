"""The pipeline against a sequential statement of its stages, on the smallest tables."""

import re

import pytest
import tiktoken

import corpus_pipeline as pipeline
from llm.common_rows import empty, odd
from llm.test_quality import slow_counts
from llm.test_mixing import shares
from llm.test_near_texts import slow_kept
from logquarry.llm import bpe, quality

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def staged(spark, upto, folder=FOLDER):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, work in pipeline.STAGES[:upto]:
        docs = pipeline.stage(work(spark, docs, folder), "test-stage")
    return docs


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"]: r for r in staged(spark, 1).collect()}
    rules = quality.learn(*quality.examples(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    judged = {r["doc_id"]: r["kept"] for r in quality.judged_by(rules, docs, ["doc_id"]).collect()}
    assert set(kept) == {d for d, k in judged.items() if k} and all(kept[d] == rows[d] for d in kept)
    for d, r in rows.items():
        n, _, _, _, repeats = slow_counts(r["text"])
        if n < 20 or 100 * repeats > 30 * n:
            assert d not in kept
        elif marks.get(d) == 1:
            assert d in kept

    last = {}
    for d in sorted(kept):
        last[kept[d]["text"].translate(LOWER)] = d
    single = {r["doc_id"]: r for r in staged(spark, 2).collect()}
    assert set(single) == set(last.values()) and all(single[d] == rows[d] for d in single)

    ids = sorted(single)
    places = slow_kept([single[d]["text"] for d in ids])
    apart = {r["doc_id"]: r for r in staged(spark, 3).collect()}
    assert set(apart) == {ids[n] for n in places} and all(apart[d] == rows[d] for d in apart)

    mixed = staged(spark, 4).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = {}, {}
    for r in apart.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    for r in mixed:
        assert apart[r["doc_id"]]["text"].startswith(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    for s, goal in shares(sizes).items():
        assert goal - 1 <= taken.get(s, 0) <= goal
    cut = [r for r in mixed if apart[r["doc_id"]]["text"] != r["text"]]
    assert len(cut) <= len(sizes) and mixed[0].asDict().keys() == rows[0].asDict().keys()

    library = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path(bpe.VOCABULARY)), special_tokens={})
    result = pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in result) == sorted((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in mixed)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in result)


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    for name, work in pipeline.STAGES:
        rows = work(spark, docs, FOLDER)
        if name != pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
        assert rows.count() <= 2 * docs.count()
    left = [(r["doc_id"], r["text"]) for r in pipeline.exact_duplicates(spark, docs, FOLDER).collect()]
    assert len(left) == len(set(left))


def test_mixture_takes_rows_apart(spark):
    """Rows that repeat an id, or have none, are taken for the words of their target and no more."""
    word = lambda n: " ".join(f"w{n}x{i}" for i in range(10))
    rows = [(None, word(n), "s") for n in range(20)] + [(7, word(100 + n), "t") for n in range(20)] + [(8, word(0), "t")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS words", "3 AS mix_start")
    mixed = pipeline.mixture(spark, docs, FOLDER).collect()
    sizes, taken, texts_ = {"s": 200, "t": 260}, {}, {r[1] for r in rows}
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
        assert any(t.startswith(r["text"]) for t in texts_)
    for s, goal in shares(sizes).items():
        assert goal - 1 <= taken[s] <= goal
    times = {}
    for r in mixed:
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert max(n for (d, _), n in times.items() if d != 8) <= 2 and times[8, word(0)] <= 12

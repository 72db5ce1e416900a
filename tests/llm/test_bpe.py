import hashlib

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm.common_rows import empty, odd
from logquarry.llm import bpe

RANKS = bpe.read_ranks(bpe.vocabulary_path(bpe.VOCABULARY))
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst hol'\n1!é漢", max_size=200)))
def test_as_the_library(text):
    assert ENCODER.text(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.sampled_from([1, 3, 40]))
def test_long_fold_is_the_short_one(word, times):
    word = (word * times)[:400]
    long = bpe.fold_long(word, RANKS)
    bpe.SHORT, kept = 1 << 30, bpe.SHORT
    try:
        parts = bpe.fold(word, {k: v for k, v in RANKS.items() if k != word} | ({word: RANKS[word]} if len(word) == 1 else {}))
    finally:
        bpe.SHORT = kept
    if word not in RANKS:
        assert long == parts


def test_very_long_words():
    for text in ("ab" * 50_000, " " * 30_000 + "x", "漢字" * 20_000, "0" * 40_000):
        assert ENCODER.text(text) == LIBRARY.encode_ordinary(text)


def test_query(spark):
    from logquarry.llm.catalog import QUERIES
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("table", [odd, empty])
def test_round_trip_of_odd_rows(spark, table):
    docs = table(spark)
    rows = bpe.encode(docs, ["doc_id", "text", "size"], RANKS).select("text", bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    assert len(rows) == docs.count()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in rows)

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.common_rows import empty, odd, texts
from logquarry.llm import token_counts as tc

PATH = tc.vocabulary_path(tc.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.Counter.load(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def check(text):
    assert COUNTER.text(text).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("text", [
    "", "Hello world, it's 12 o'clock\n\n  we'll  see you've\t\tx", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x", "a<|endoftext|> b<|endo",
    "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "'re 're'll don'r 'v", "Übergrößen 漢字かな交じり文 \U0001f600\U0001f680 Ænea", "՘ ꟎",
    "keitstlichschenverpf THENATIONERENDSHTINT 4952935900253052", "a   b\x1c\x85c",
])
def test_every_prefix(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrst heo.'lvd\n\t 12!<|>é漢")), max_size=30))
def test_every_prefix_of_generated_texts(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=25))
def test_every_prefix_of_any_characters(text):
    check(text)


def test_agreed_code_points():
    """The pattern splits as the library does around every code point it is trusted with."""
    import regex
    agreed = regex.compile(tc.AGREED)
    pre, pattern = LIBRARY.pre_tokenizer, regex.compile(tc.PIECES)
    for code in range(0x20000):
        c = chr(code)
        if not 0xD800 <= code < 0xE000 and agreed.match(c):
            text = f"ab{c}1 {c} x"
            assert pattern.findall(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], hex(code)


def test_given_tables(spark):
    from logquarry.llm.catalog import QUERIES
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), library(text))
        assert r["over_limit"] == (r["n_tokens"] > 512)


def test_truncation(spark):
    rows = texts(spark, ["Hello hello hello world", "", None, "unbelievable"])
    counted = tc.prefix_counts(rows, ["doc_id", "text"])
    for budget in range(6):
        for r in counted.select("text", tc.truncated_length(F.col("prefix_tokens"), budget).alias("n")).collect():
            text = r["text"] or ""
            assert r["n"] == max(i for i in range(len(text) + 1) if library(text[:i]) <= budget)


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    rows = tc.prefix_counts(docs, ["doc_id", "text", "key"]).select("text", tc.tokens(F.col("prefix_tokens")).alias("n")).collect()
    assert len(rows) == docs.count() and all(r["n"] == library(r["text"] or "") for r in rows)


def test_many_pieces_at_once_as_one_by_one():
    """Pieces of all lengths, with pairs that share places of a small table."""
    import random

    counter = tc.Counter.load(tc.vocabulary_path(tc.VOCABULARY))
    at_once, draw = tc.AtOnce(counter), random.Random(2)
    tokens = sorted(counter.tokens)
    pieces = ["".join(draw.choices("abc é漢-", k=draw.randint(1, 10))).encode() for _ in range(300)]
    pieces += [b"".join(draw.choices(tokens, k=draw.randint(1, 4)))[:tc.LONG] for _ in range(700)] + [b"a", b" ", b"-" * 32]
    expected = [counter.counts(p) for p in pieces]
    assert at_once.counts(pieces) == expected
    tc.PLACES, places = 4, tc.PLACES
    try:
        assert at_once.counts(pieces) == expected and at_once.counts([b"x"]) == [counter.counts(b"x")] and at_once.counts([]) == []
    finally:
        tc.PLACES = places


def test_frequent_pieces_are_never_forgotten():
    worked = []
    known = tc.Known(lambda k: worked.append(k) or k, 3)
    for n in range(20):
        assert known["often"] == "often" and known[f"once {n}"] == f"once {n}"
    assert worked.count("often") == 1 and len(known) + len(known.old) <= 6

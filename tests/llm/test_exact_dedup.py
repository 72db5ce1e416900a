import hashlib

import pytest
from pyspark.sql import functions as F

from llm.common_rows import empty, odd, texts
from logquarry.llm import exact_dedup as dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc)
    out = []
    for doc, text in rows:
        plain = (text or "").translate(LOWER)
        ids = [d for d in groups[plain] if d is not None]
        keep = max(ids, default=None)
        out.append((doc, keep, len(groups[plain]), doc == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted((tuple(r) for r in dedup.exact_groups(docs, **options).collect()), key=str)


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    assert found(docs) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_clashing_hashes_are_told_apart(spark):
    """With a hash of seven values nearly every chunk clashes, and the result is the same."""
    sentence = "Some words that go on, and on. "
    docs = texts(spark, [sentence * n for n in (1, 8, 9, 10, 30, 31, 30, 9)] + ["x" * 3000, "y" * 3000, "X" * 3000, "Ä" * 700, "ä" * 700, None, ""])
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(7))
    assert found(docs, digest=weak) == expected([(r["doc_id"], r["text"]) for r in docs.collect()]) == found(docs)


def test_chunks_are_cut_by_content(spark):
    """After an insertion near the start, most chunks of a long text are the same again."""
    import random
    draw = random.Random(1)
    text = " ".join("".join(draw.choices("abcdefgh", k=5)) + ("." if draw.random() < 0.2 else "") for _ in range(8000))
    a, b = (set(r[0]) for r in texts(spark, [text, "Inserted words. " + text]).select(dedup.chunks(F.col("text"))).collect())
    assert len(a & b) > 0.9 * len(a)
    joined = texts(spark, [text]).select(F.array_join(dedup.chunks(F.col("text")), "")).first()[0]
    assert joined == text

import hashlib
import random

import numpy as np
import pytest

from llm.common_rows import empty, odd, texts
from logquarry.llm import substrings as sub


def brute(rows, width=sub.WIDTH):
    """doc_id, text -> spans by comparing every string with a table of first places."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            s, place = data[i:i + width], ((doc is not None, doc or 0), i)
            if s not in first or place < first[s]:
                first[s] = place
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if first[data[i:i + width]] < ((doc is not None, doc or 0), i):
                gone[i:i + width] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((doc, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def found(docs, **options):
    return [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in sub.without_repeats(docs, **options).collect()]


def key(row):
    return row[0] is not None, row[0] or 0, row[3]


def test_classes_of_shared_prefixes():
    draw = random.Random(5)
    for _ in range(60):
        parts = [bytes(draw.choice(b"abc") for _ in range(draw.randint(6, 30))) for _ in range(draw.randint(1, 6))]
        parts += [p[3:] + b"a" for p in parts]
        width = draw.randint(1, 7)
        symbols = np.concatenate([np.concatenate([np.frombuffer(p, np.uint8).astype(int) + len(parts), [i]]) for i, p in enumerate(parts)])
        order, classes = sub.shared_prefix_classes(symbols, len(parts), width)
        words = [tuple(symbols[i:i + width]) for i in order]
        for a in range(1, len(order)):
            assert (classes[a] == classes[a - 1]) == (words[a] == words[a - 1])


def generated(seed, count=40):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(count):
        text = " ".join(word() for _ in range(draw.randint(0, 120)))
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passage)
            a = draw.randint(0, len(p) // 2)
            text = text[:50] + p[a:a + draw.randint(60, 250)] + text[50:]
        if draw.random() < 0.1:
            text += "x" * draw.randint(90, 300)
        if rows and draw.random() < 0.2:
            text = draw.choice(rows)[1] + text[:20]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"crowd": 3}, {"block_bytes": 2000}, {"crowd": 3, "block_bytes": 500}])
def test_against_brute_force(spark, options):
    rows = generated(len(options) + 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    assert sorted(found(docs, **options), key=key) == sorted(brute(rows), key=key)


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sub, "CHUNK", 150)
    rows = generated(9, 12)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    assert sorted(found(docs), key=key) == sorted(brute(rows), key=key)


def test_query(spark):
    from logquarry.llm.catalog import QUERIES
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = {d: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute(rows)}
    result = QUERIES["op4_repeated_passages"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result} == expected
    assert any(v[1] for v in expected.values()) and len(result) == len(expected)


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(found(docs), key=key) == sorted(brute(rows), key=key)
    assert found(texts(spark, ["a" * 99, "a" * 99])) [1][2] == []

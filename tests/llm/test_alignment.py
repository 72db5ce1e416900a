"""Alignment against a statement over plain lists, with both libraries asked directly."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm.common_rows import empty, odd, texts
from logquarry.llm import alignment
from logquarry.llm.token_counts import byte_letters

FACTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
LETTERS = byte_letters()


def slow(rows):
    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    grouped = []
    for _, text in rows:
        groups = []
        if text:
            e = a_lib.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
            b = [(i, bytes([i - 3]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
            whole = (" " + text).encode()
            if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b):
                ends = []
                for side in (a, b):
                    at, found = 0, []
                    for _, t in side:
                        at += len(t)
                        found.append(at)
                    ends.append(found)
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[n].index(cut, at[n]) + 1 for n in (0, 1)]
                    groups.append(([i for i, _ in a[at[0]:to[0]]], [i for i, _ in b[at[1]:to[1]]]))
                    at = to
        grouped.append(groups)
    counts = Counter()
    for groups in grouped:
        counts.update({(x, y) for left, right in groups for x in left for y in right})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), groups in zip(rows, grouped, strict=True):
        links = [(x, y) for left, right in groups for x in left for y in right]
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted((tuple(r[c] for c in FACTS) for r in alignment.alignment(docs, ["doc_id"], **options).collect()), key=str)


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    assert found(docs) == slow(listed(docs))


def test_strange_texts_and_small_blocks(spark):
    rows = [
        "plain words and 12345 numbers", "<|endoftext|> and <s> </s> <unk> as text", "tabs\tand\n\nlines   with  blanks ", "   ",
        "漢字かな交じり文 \U0001f600\U0001f468‍\U0001f469 é é Ǆ", "▁ under ▁▁", "nul \x00 byte", "﻿mark   blank 　",
        "ꙮ ᛗ 𐍈 𝔘 rare", "x" * 3000, "=" * 2500 + "a" * 2500, "don't we've THEY'LL", None, "", "plain words and 12345 numbers",
        " " * 7000 + "end", "0123456789" * 300,
    ]
    docs = texts(spark, rows)
    assert found(docs, block_pairs=20) == slow(listed(docs)) == found(docs)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs.repartition(3), block_pairs=5_000) == slow(listed(docs))


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = alignment.op12(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r[c] for c in FACTS) for r in rows.collect()), key=str) == slow(listed(docs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=60), st.integers(0, 9)), min_size=1, max_size=5))
def test_cuts_are_the_common_ends(parts):
    a_ends, b_ends, counts, base, common = [], [], [], 0, []
    for lengths, seed in parts:
        total = sum(lengths)
        ends = list(np.cumsum(lengths)) if lengths else []
        draw = random.Random(seed)
        other = sorted({total, *draw.sample(range(1, total + 1), total // 3)}) if total else []
        a_ends += [base + e for e in ends]
        b_ends += [base + e for e in other]
        common += [len(a_ends) - len(ends) + i + 1 for i, e in enumerate(ends) if e in other]
        counts.append(len(ends))
        base += total
    if not a_ends:
        return
    a_to, b_to = alignment.group_bounds(np.array(a_ends), np.array(b_ends), np.array(counts))
    assert a_to.tolist() == common
    assert [a_ends[i - 1] for i in a_to] == [b_ends[i - 1] for i in b_to]


def test_large_groups_count_their_links():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 50, 300), draw.integers(0, 40, 200)
    owners, keys, times = alignment.pair_counts(np.array([0, 1]), a, b, np.array([200, 300]), np.array([150, 200]), 100)
    expected = Counter()
    for doc, (x, y) in enumerate((((0, 200), (0, 150)), ((200, 300), (150, 200)))):
        for i in a[x[0]:x[1]]:
            for j in b[y[0]:y[1]]:
                expected[doc, int(i) * 100 + int(j)] += 1
    assert dict(zip(zip(owners.tolist(), keys.tolist(), strict=True), times.tolist(), strict=True)) == expected

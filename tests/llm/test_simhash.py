import random
import re

import pytest
import xxhash

from llm.common_rows import empty, odd
from logquarry.llm import simhash
from logquarry.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def slow_classes(values):
    return joined([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2], values)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("crowd", [64, 3, 1])
def test_links_of_close_values(spark, crowd):
    """Balls of values around few centres, with chains, crowded halves and far values."""
    draw = random.Random(crowd)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(40):
            v = centre
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                v ^= 1 << bit
            values.add(v)
    for low in range(12):
        values.add(0xABCDEF << 40 | draw.getrandbits(32))
        values.add(draw.getrandbits(32) << 32 | 77)
    values = sorted(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "value long")
    rows = {r["node"]: r["root"] for r in components(simhash.links(df, crowd)).collect()}
    expected = slow_classes(values)
    groups = {}
    for v in values:
        groups.setdefault(expected[v], set()).add(rows.get(signed(v), signed(v)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    draw = random.Random(2)
    for size, count in ((40, 30), (60, 60), (30, 0)):
        pairs = [(draw.randrange(size), draw.randrange(size)) for _ in range(count)] + [(i, i + 1) for i in range(100, 140)]
        nodes = {n for p in pairs for n in p}
        rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in rows} == joined(pairs, nodes) and len(rows) == len(nodes)


def check(spark, docs, rows):
    prints = {i: slow_fingerprint(t) for i, (_, t) in enumerate(docs)}
    expected = slow_classes(sorted(set(prints.values())))
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            c = expected[prints[i]]
            least[c] = min(least.get(c, doc), doc)
    wanted = sorted((str(d), f"{prints[i]:016x}", str(least.get(expected[prints[i]]))) for i, (d, _) in enumerate(docs))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == wanted


def test_query(spark):
    from logquarry.llm.catalog import QUERIES
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(spark, docs, QUERIES["op8_simhash"](spark, folder).collect())


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], simhash.near_duplicates(docs).collect())

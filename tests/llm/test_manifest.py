"""The manifest against a tree built and climbed on plain lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm.common_rows import empty, odd
from logquarry.llm import manifest

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(digests, at):
    """(root, siblings on the left and right of each level) of the leaf at place `at`."""
    way = []
    while len(digests) > 1:
        first = at // 16 * 16
        run = digests[first:first + 16]
        way.append(("".join(run[:at - first]), "".join(run[at - first + 1:])))
        digests = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)]
        at //= 16
    return digests[0], way


def slow(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climbed([leaf_of(r) for r in sources[s]], 0)[0] for s in names]
    out = []
    for place, s in enumerate(names):
        root, above = climbed(subroots, place)
        digests = [leaf_of(r) for r in sources[s]]
        for at, row in enumerate(sources[s]):
            subroot, way = climbed(digests, at)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            own = leaf_of((*row[:4], row[4].translate(LOWER) if row[4] is not None else None)) if tampered else digests[at]
            for left, right in way + above:
                own = sha(left + own + right)
            proof = sha("".join(left + right for left, right in way + above))
            out.append((row[0], digests[at], subroot, root, proof, own, own == root))
    return sorted(out, key=str)


def found(docs):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    result = manifest.manifest(docs, manifest.FIELDS, tampered, manifest.lower_text(F.col("text")))
    return sorted((tuple(r[c] for c in COLUMNS) for r in result.collect()), key=str)


@pytest.mark.parametrize("table", [odd, empty])
def test_odd_rows(spark, table):
    docs = table(spark)
    assert found(docs) == slow([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])


def test_sources_of_all_heights(spark):
    """Lone leaves, full and partial runs, three levels; more sources than one run; repeated rows over several runs."""
    sizes = {None: 17, "": 1, "a": 16, "b": 257, "é": 300, "Z": 33, "𝔘": 2} | {f"s{i}": 1 for i in range(20)}
    rows = [(i * 7 % 1000, s, None if i % 3 else "en", i, f"Text {i}") for s, n in sizes.items() for i in range(n)]
    rows += [(5, "b", None, 1, "Twice")] * 40 + [(None, "b", None, None, f"No Id {i % 4}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    expected = slow(rows)
    assert found(docs) == expected
    assert {r[6] for r in expected} == {True, False}


def test_one_source_one_row(spark):
    docs = spark.createDataFrame([(5, "s", "en", 1, "X")], "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == slow([(5, "s", "en", 1, "X")])

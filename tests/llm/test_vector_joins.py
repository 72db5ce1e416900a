"""Vector links against all pairs, on clustered and odd vectors."""

import math

import numpy as np
import pytest

from logquarry.llm import vector_joins

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, least=0.93):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    links = {i: set() for i in range(n)}
    vectors = [np.array(v, np.float32).astype(float) if good(v, label) else None for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if vectors[i] is None or vectors[j] is None or rows[i][2] != rows[j][2] or len(vectors[i]) != len(vectors[j]):
                continue
            if vectors[i] @ vectors[j] / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(n):
        if i in seen:
            continue
        part, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()] - part:
                part.add(j)
                queue.append(j)
        ids = [rows[j][0] for j in part if rows[j][0] is not None]
        seen |= {j: min(ids, default=None) for j in part}
    for i in range(n):
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS node", "2 AS hash", "3 AS weight", "4 AS row_id", "'x' AS vector")
    result = vector_joins.linked_classes(df, "vec_id", "embedding", "label", **options)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in result.collect()), key=str)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [1.0, None], 0),
        (8, [1.0, nan], 0), (9, [inf, 0.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 1),
        (None, [0.0, 1.0], 1), (None, None, 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 5.0], 2), (14, [0.0, 5.0], 2), (15, [-1.0, 0.0], 0),
        (16, [3e38, 3e38], 3), (17, [1e-30, 1e-30], 3), (18, [1.0], 4), (19, [-1.0], 4), (20, [None], 4), (21, [1.0], 4),
    ]
    assert found(spark, rows) == slow(rows)
    assert found(spark, [], cell=1) == []


@pytest.mark.parametrize("cell, tile, sample", [(10, 7, 50), (40, 1000, 4096), (1000, 30, 3)])
def test_clusters_chains_and_copies(spark, cell, tile, sample):
    """Dense groups, chains whose ends do not link, copies, and scattered vectors, over few and many cells."""
    draw = np.random.default_rng(3)
    rows = []
    for label in range(3):
        for _ in range(6):
            centre = draw.normal(size=8)
            spread = draw.choice([0.02, 0.1, 0.25])
            rows += [(centre / np.linalg.norm(centre) + spread * draw.normal(size=8) / 3, label) for _ in range(int(draw.integers(5, 40)))]
        angle = np.linspace(0, 3, 25)
        rows += [(np.r_[np.cos(a), np.sin(a), np.zeros(6)], label) for a in angle]
        rows += [(draw.normal(size=8), label) for _ in range(40)]
        rows += [rows[-1]] * 30
    rows = [(i * 3, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    assert found(spark, rows, cell=cell, tile=tile, sample=sample) == slow(rows)


def test_a_dense_group_is_not_compared(spark):
    """All members of a core meet nothing but what lies outside of it."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.r_[1, 0.01 * draw.normal(size=15)]], 0) for i in range(600)]
    rows += [(1000 + i, [float(x) for x in draw.normal(size=16)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS row_id", "embedding AS vector", "label")
    vectors = vector_joins.distinct_vectors(df)
    radius = math.sqrt(2 - 2 * 0.93)
    points = vector_joins.pivots(vectors, radius, 100, 4096)
    assert sum(np.linalg.norm(p - np.eye(16)[0]) < 0.3 for p in points["0", 16]) == 1
    home = vector_joins.homes(vectors, points, radius)
    assert home.where("core").count() >= 600
    assert found(spark, rows, cell=100) == slow(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    result = vector_joins.op11(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in result), key=str) == slow(rows)


def test_forest_keeps_what_is_connected():
    near = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0]], bool)
    rows, columns = vector_joins.forest(near)
    assert sorted(zip(rows.tolist(), columns.tolist(), strict=True)) == [(0, 0), (0, 3), (1, 1), (1, 3)]
    assert len(vector_joins.forest(np.ones((50, 40), bool))[0]) == 89

"""An inverted-file index over chunk vectors: nearest chunks without comparing every query with every chunk.

Centres are fitted on a bounded sample of chunks; every chunk belongs to the cell of its nearest centre. A query is
compared, exactly, with the chunks of the cells whose centres are nearest to it. What it finds is a part of the exact
answer: all of it when every cell is probed. `recall` measures how much; `retrieval.nearest` stays the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logquarry.functions.arrays import unfold
from logquarry.operators.retrieval import CHUNK_TILE, LARGEST_TILE, TILES, nearest, unit
from logquarry.staging import stage

# Chunks the centres are fitted on, the first in the order of md5 of their id; these alone go to the driver.
SAMPLE = 20_000
MAX_CELLS = 2048
ROUNDS = 10
# The number of cells a query looks into is fitted so that this part of the neighbours of sample chunks is found.
WANTED, NEIGHBOURS, ASKED = 0.95, 10, 500


@dataclass(frozen=True)
class ChunkIndex:
    """`cells` is a written table (chunk_id, vector, cell) in the order of cells; `centres` has a row for each cell."""

    cells: DataFrame
    centres: np.ndarray
    probes: int


def fitted(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by k-means on unit vectors. It starts from vectors at even distances in the given order; a centre
    that no vector is nearest to stays where it is, so the result depends on nothing but the input."""
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def enough_probes(vectors: np.ndarray, centres: np.ndarray) -> int:
    """The least number of cells that hold WANTED of the nearest neighbours, within the sample, of ASKED sample vectors.
    Neighbours in the whole table are nearer than those in a sample, so this number errs to the large side."""
    asked = vectors[:ASKED]
    scores = asked @ vectors.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :min(NEIGHBOURS, max(1, len(vectors) - 1))]
    own = np.argmax(vectors @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), WANTED, method="higher")) + 1


def closest(centres: np.ndarray, n: int):
    """A pandas UDF: the `n` cells nearest to a vector, the nearest first."""
    small = centres.astype(np.float32)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        scores = unit(vectors).astype(np.float32) @ small.T
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells


def build(chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> ChunkIndex:
    """Index chunks (chunk_id, vector). Without a number of cells it is the square root of the number of chunks, at
    most MAX_CELLS and a quarter of the sample. Every chunk is indexed, chunks with a null vector excepted; a table
    without chunks has one empty cell."""
    rows = chunks.where("vector IS NOT NULL").select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    some = rows.orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id").limit(sample).select("vector").toPandas()
    if some.empty:
        return ChunkIndex(stage(rows.withColumn("cell", F.lit(0)), "cells"), np.zeros((1, 1)), 1)
    wanted = cells or min(MAX_CELLS, round(rows.count() ** 0.5), max(1, len(some) // 4))
    vectors = unit(some.vector)
    centres = fitted(vectors, max(1, min(wanted, len(some))))
    placed = rows.withColumn("cell", F.get(closest(centres, 1)("vector"), F.lit(0)))
    # In the order of cells, so that a search with few queries skips the row groups of other cells; a cell that holds
    # much of the table is still written by many tasks.
    placed = stage(placed, "placed-chunks").repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell")
    return ChunkIndex(stage(placed, "cells"), centres, enough_probes(vectors, centres))


def search(index: ChunkIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k best chunks per query (query_id, vector) among those of its `probes` nearest cells, as `nearest` gives them.

    Cells are put together to groups of about a tile of chunks. A group is a bucket of `nearest`: a query is sent once to
    each group that has a cell of it, however many cells it looks into, and its queries and chunks meet in tiles, so a
    cell of any size is bounded work."""
    n = min(len(index.centres), probes or index.probes)
    if index.cells.isEmpty():
        return nearest(queries, index.cells, k)
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    groups = cell_groups(index)
    each = unfold(asked, ["query_id", "vector"], grouped(index.centres, n, groups)("vector"), "g").select(
        "query_id", "vector", "g.part", "g.cells")
    number = F.get(F.lit(groups), F.col("cell"))
    return nearest(stage(each, "probes"), index.cells.withColumn("part", number), k, bucket="part", by_cell=True)


def cell_groups(index: ChunkIndex) -> list[int]:
    """The group of each cell. A group is full with as many chunks as a tile of `nearest` has, so that it is cut no further
    unless a single cell is larger."""
    sizes = np.zeros(len(index.centres), np.int64)
    for row in index.cells.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    full = min(LARGEST_TILE, max(CHUNK_TILE, -(-int(sizes.sum()) // TILES)))
    return ((np.cumsum(sizes) - 1).clip(0) // full).tolist()


def grouped(centres: np.ndarray, n: int, groups: list[int]):
    """A pandas UDF: the `n` cells nearest to a vector, by their groups."""
    small, number = centres.astype(np.float32), np.array(groups)

    @F.pandas_udf("array<struct<part:int,cells:array<int>>>")
    def cells(vectors: pd.Series) -> pd.Series:
        def by_group(near):
            near = np.sort(near)
            parts, starts = np.unique(number[near], return_index=True)
            return [{"part": int(p), "cells": c} for p, c in zip(parts, np.split(near.astype(np.int32), starts[1:]), strict=True)]

        if vectors.empty:
            return pd.Series([], dtype=object)
        scores = unit(vectors).astype(np.float32) @ small.T
        return pd.Series([by_group(near) for near in np.argsort(-scores, axis=1, kind="stable")[:, :n]])

    return cells


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the number of exact hits, and the part of them that was found."""
    hits = exact.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

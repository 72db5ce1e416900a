"""Documentation for findings: query text, nearest chunks, thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.patterns import find_all
from logquarry.staging import broadcast_if_small, only_wanted, stage

# What is taken from an excerpt into the query text, in this order.
EXCEPTION_PATTERNS = (
    r"\b\w+Exception\b", r"\b\w+Error\b", r"\bTypeError\b", r"\bValueError\b", r"\bKeyError\b", r"\bAttributeError\b",
    r"\bImportError\b", r"\bModuleNotFoundError\b", r"\bConnectionError\b", r"\bTimeoutError\b",
)
FILE_PATTERNS = (
    r"\b\w+\.py\b", r"\b\w+\.js\b", r"\b\w+\.php\b", r"\bmodules/\w+\b", r"\bcomponents/\w+\b", r"\bservices/\w+\b",
)
DOMAIN_PATTERNS = (
    r"\b\w+integration\b", r"\b\w+service\b", r"\b\w+plugin\b", r"\b\w+module\b", r"\b\w+component\b",
)
KEYWORDS = (
    "connection", "timeout", "failed", "denied", "forbidden", "unauthorized", "certificate", "ssl", "tls", "database",
    "authentication", "permission", "configuration", "dependency",
)

TOP_K = 5
THRESHOLD = 0.7
MAX_CHUNKS = 10

# Queries and chunks per unit of scoring work, at least. Every row is sent to all tiles of the other side, so tiles grow
# with the table: a side is cut into TILES of them until they have LARGEST_TILE rows, which bounds the memory of a unit.
QUERY_TILE = 1024
CHUNK_TILE = 4096
TILES, LARGEST_TILE = 8, 32_768
# Scores that a unit holds at once, and candidates whose vectors it holds.
SCORES, CANDIDATES = 1 << 22, 1 << 16
# Columns of scores of which the greatest is taken together, at most, and groups of them that there are at least.
COLUMNS, GROUPS = 32, 64
SCORE_DIGITS = 6


def query_parts(message: Column, excerpt: Column, pipeline: Column) -> Column:
    """Distinct parts of the query text in order of appearance."""
    text = F.array_join(excerpt, " ")
    low = F.lower(text)

    def optional(value: Column) -> Column:
        return F.when(F.length(value) > 0, F.array(value)).otherwise(F.array().cast("array<string>"))

    # What the named exceptions match has been found by the two patterns before them; distinct parts lose nothing.
    found = [find_all(text, p, ignore_case=True) for p in EXCEPTION_PATTERNS[:2]]
    found += [find_all(text, p) for p in FILE_PATTERNS]
    found += [find_all(text, p, ignore_case=True) for p in DOMAIN_PATTERNS]
    words = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEYWORDS]))
    return F.array_distinct(F.concat(optional(message), *found, words, optional(pipeline)))


def query_text(message: Column, excerpt: Column, pipeline: Column) -> Column:
    return F.array_join(query_parts(message, excerpt, pipeline), " ")


def nearest(queries: DataFrame, chunks: DataFrame, k: int, bucket: str | None = None,
            query_tile: int = QUERY_TILE, chunk_tile: int = CHUNK_TILE, by_cell: bool = False) -> DataFrame:
    """The k chunks with the greatest inner product of unit vectors per query: query_id, chunk_id, score, rank.

    queries (query_id, vector), chunks (chunk_id, vector); with `bucket` a column of both, only equal buckets are
    compared, and a query may appear in several buckets. Scoring is exact. Both sides are cut into tiles of `query_tile`
    and `chunk_tile` rows or more (see TILES), tile against tile is one bounded unit of work that gives back k rows per
    query, and the units of a query are merged by rank. With `by_cell` a chunk has a number `cell`, and a query is compared
    with the chunks of its `cells` only.
    """
    mark = F.col(bucket).cast("string") if bucket else F.lit("")
    q_more, c_more = (["cells"], ["cell"]) if by_cell else ([], [])
    q = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"), mark.alias("bucket"), *q_more)
    c = chunks.select("chunk_id", F.col("vector").cast("array<float>").alias("vector"), mark.alias("bucket"), *c_more)

    def sized(df: DataFrame, tile: int, name: str) -> DataFrame:
        counted = df.groupBy("bucket").agg(F.count("*").alias("n"))
        fewest = F.greatest(F.lit(TILES), F.ceil(F.col("n") / LARGEST_TILE))
        return counted.select("bucket", F.least(F.ceil(F.col("n") / tile), fewest).cast("int").alias(name))

    if bucket:
        # One row per bucket; vectors meet it where they are, without a shuffle by bucket.
        tiles = broadcast_if_small(stage(
            sized(q, query_tile, "query_tiles").join(sized(c, chunk_tile, "chunk_tiles"), "bucket"), "tiles"))
        q, c = q.join(tiles, "bucket"), c.join(tiles, "bucket")
    else:
        def tiles_of(n: int, tile: int) -> Column:
            return F.lit(min(-(-n // tile), max(TILES, -(-n // LARGEST_TILE))))

        sizes = {"query_tiles": tiles_of(q.count(), query_tile), "chunk_tiles": tiles_of(c.count(), chunk_tile)}
        q, c = q.withColumns(sizes), c.withColumns(sizes)

    def spread(df: DataFrame, key: str, own: str, other: str, own_name: str, other_name: str, more: list[str]) -> DataFrame:
        rows = df.where(F.col(other) > 0).select(
            key, "vector", "bucket", *more, F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own_name),
            F.sequence(F.lit(0), F.col(other) - 1).alias("others"))
        return unfold(rows, [key, "vector", "bucket", *more, own_name], "others", other_name)

    keys = ["bucket", "query_part", "chunk_part"]
    left = spread(q, "query_id", "query_tiles", "chunk_tiles", "query_part", "chunk_part", q_more)
    right = spread(c, "chunk_id", "chunk_tiles", "query_tiles", "chunk_part", "query_part", c_more)

    def score(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        offered = offered.sort_values("chunk_id", kind="stable")
        left, right = unit(asked.vector), unit(offered.vector)
        rows, columns, scores = best_in_cells(
            left, asked.cells, right, offered.cell.to_numpy(), k) if by_cell else best_of(left, right, k)
        return pd.DataFrame({
            "query_id": asked.query_id.to_numpy()[rows], "chunk_id": offered.chunk_id.to_numpy()[columns], "score": scores})

    types = {"query_id": q.schema["query_id"].dataType.simpleString(),
             "chunk_id": c.schema["chunk_id"].dataType.simpleString()}
    units = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        score, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return units.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(asked: np.ndarray, offered: np.ndarray, k: int, reached: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores): for each row of `asked`, whose length is one or zero, the k rows of `offered` with the greatest
    rounded inner products, the first ones of equal products; those that are no numbers come last.

    `reached` holds for each row the k greatest products known from elsewhere, as `candidates` finds them, and is brought up to
    date; rows of `offered` that cannot be among the k best of both may be left out."""
    known = not (np.isnan(asked).any() or np.isnan(offered).any()) and k < len(offered)
    parts, step = [], max(1, SCORES // len(offered))
    if known:
        quick = asked.astype(np.float32), offered.astype(np.float32)
    for at in range(0, len(asked), step):
        if known:
            rows, columns = candidates(quick[0][at:at + step], quick[1], k, None if reached is None else reached[at:at + step])
            ends = range(0, len(rows), CANDIDATES)
            scores = [np.einsum("ij,ij->i", asked[at + rows[i:i + CANDIDATES]], offered[columns[i:i + CANDIDATES]]) for i in ends]
            scores = np.concatenate([np.zeros(0), *scores])
        else:
            scores = asked[at:at + step] @ offered.T
            rows, columns = (x.ravel() for x in np.indices(scores.shape))
            scores = scores.ravel()
        parts.append(first_of(rows + at, columns, np.round(scores, SCORE_DIGITS) + 0.0, k))
    rows, columns, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, columns, found


def candidates(asked: np.ndarray, offered: np.ndarray, k: int, reached: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of all products of 32-bit numbers that may be among the k greatest of their row, k < len(offered).

    Columns are taken in groups. The k-th of the greatest products of groups is reached by k products at least; only groups
    that come up to it are looked into. What is left out is less by more than 32-bit products and rounding can be wrong."""
    n = len(offered)
    deep = max(1, min(COLUMNS, n // max(GROUPS, 4 * k)))
    groups = -(-n // deep)
    scores = np.empty((len(asked), deep * groups), np.float32)
    scores[:, n:] = -np.inf
    np.matmul(asked, offered.T, out=scores[:, :n])
    scores = scores.reshape(len(asked), deep, groups)
    most = scores.max(axis=1)
    least = np.partition(most, groups - k, axis=1)[:, groups - k:]
    if reached is not None:
        least = reached[:] = np.partition(np.concatenate([reached, least], axis=1), k, axis=1)[:, k:]
    wrong = 2 * (offered.shape[1] + 4) * 2.0 ** -23 + 10.0 ** -SCORE_DIGITS * 1.01
    least = (least.min(axis=1).astype(np.float64) - wrong).astype(np.float32)
    rows, group = np.nonzero(most >= least[:, None])
    at, depth = np.nonzero(scores[rows, :, group] >= least[rows, None])
    return rows[at], depth * groups + group[at]


def first_of(rows: np.ndarray, columns: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order."""
    order = np.lexsort((columns, -found, rows))
    rows, columns, found = rows[order], columns[order], found[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], columns[first], found[first]


def best_in_cells(
    asked: np.ndarray, cells: pd.Series, offered: np.ndarray, cell: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_of`, where each row of `asked` meets those rows of `offered` only whose cell is among its `cells`."""
    owner = np.repeat(np.arange(len(asked)), cells.map(len).to_numpy())
    wanted = np.concatenate(cells.to_numpy())
    by_query, by_chunk = np.argsort(wanted, kind="stable"), np.argsort(cell, kind="stable")
    owner, wanted, sorted_cell = owner[by_query], wanted[by_query], cell[by_chunk]
    parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64))]
    reached = np.full((len(asked), k), -np.inf, np.float32)
    for one in np.intersect1d(wanted, sorted_cell):
        who = owner[slice(*np.searchsorted(wanted, [one, one + 1]))]
        what = by_chunk[slice(*np.searchsorted(sorted_cell, [one, one + 1]))]
        so_far = reached[who]
        rows, columns, found = best_of(asked[who], offered[what], k, so_far)
        reached[who] = so_far
        parts.append((who[rows], what[columns], found))
    return first_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)


def unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def in_repos(queries: DataFrame, module_repos: DataFrame) -> DataFrame:
    """One row per query and repository of its module (module, repo_id)."""
    return queries.join(module_repos.distinct(), "module")


def retrieve(queries: DataFrame, chunks: DataFrame, module_repos: DataFrame | None = None, *, top_k: int = TOP_K,
             threshold: float = THRESHOLD, max_chunks: int = MAX_CHUNKS, similarity: str = "cosine",
             prefilter: bool = True) -> DataFrame:
    """Ranked chunks per query: the best `max_chunks`, those similar enough, one per content, the first `top_k`.

    queries (query_id, module, vector); chunks (chunk_id, repo_id, vector, heading, content, file_path).
    similarity  `cosine`, or `inverse` for 1 / (1 + score), which prefers low scores
    prefilter   compare with the module's repositories only; otherwise take the best 2 * max_chunks of all first
    """
    if module_repos is None:
        hits = nearest(queries, chunks, max_chunks)
    elif prefilter:
        hits = nearest(in_repos(queries, module_repos), chunks, max_chunks, bucket="repo_id")
    else:
        wide = nearest(queries, chunks, 2 * max_chunks)
        allowed = in_repos(queries.select("query_id", "module"), module_repos).select("query_id", "repo_id")
        owned = wide.join(chunks.select("chunk_id", "repo_id"), "chunk_id")
        order = Window.partitionBy("query_id").orderBy("rank")
        hits = (owned.join(allowed, ["query_id", "repo_id"], "left_semi").drop("repo_id")
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_chunks))
    shown = F.when(F.col("score") != -1, 1 / (1 + F.col("score"))) if similarity == "inverse" else F.col("score")
    good = stage(hits.withColumn("similarity", shown).where(F.col("similarity") >= threshold), "hits")
    # Contents of chunks that nothing hit are not moved.
    hit_chunks = only_wanted(chunks.select("chunk_id", "repo_id", "heading", "content", "file_path"), ["chunk_id"], good)
    # One shuffle by query serves both rankings.
    texts = good.join(hit_chunks, "chunk_id").repartition("query_id")
    same = Window.partitionBy("query_id", "content").orderBy("rank")
    distinct = texts.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    final = Window.partitionBy("query_id").orderBy("rank")
    return distinct.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top_k)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def normalised(vector: Column) -> Column:
    """The vector with length one; a zero vector stays as it is."""
    length = F.sqrt(inner_product(vector, vector))
    return F.transform(vector, lambda v: F.when(length > 0, v.cast("double") / length).otherwise(v.cast("double")))

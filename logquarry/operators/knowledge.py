"""The table of documentation chunks: what must be indexed again, upserts, removal, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REPO_LISTING = 100


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.count("*").alias("chunk_count"))


def repo_status(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories (repo_id, url, branch, commit_hash, indexed_hash) with chunk_count and needs_reindexing."""
    return repos.join(chunk_counts(chunks), "repo_id", "left").select(
        *repos.columns, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        (~F.col("indexed_hash").eqNullSafe(F.col("commit_hash"))).alias("needs_reindexing"))


def reindex_plan(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories whose commit is not the indexed one, or that have no chunks."""
    return repo_status(repos, chunks).where(F.col("needs_reindexing") | (F.col("chunk_count") == 0))


def store_stats(chunks: DataFrame, dimension: int = 384) -> DataFrame:
    """One row: number of chunks and vectors, their size, and the memory an index of them needs."""
    counted = chunks.agg(F.count("*").alias("total_chunks"), F.count("embedding").alias("vectors"),
                         F.max(F.size("embedding")).alias("found"))
    size = F.when(F.col("vectors") > 0, F.col("found")).otherwise(dimension)
    return counted.select(
        "total_chunks", "vectors", size.cast("long").alias("dimension"),
        (F.col("vectors") * size * 4 / F.lit(1024 ** 3)).alias("estimated_gb"))


def repo_chunks(chunks: DataFrame, repo: str, limit: int = REPO_LISTING) -> DataFrame:
    return chunks.where(F.col("repo_id") == repo).orderBy("chunk_id").limit(limit)


def upserted(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The stored chunks with those of the batch put in or in place of theirs; the last of equal ids wins.

    Stored rows are only filtered by id; their texts and vectors do not pass through an aggregate.
    """
    rest = [c for c in stored.columns if c != "chunk_id"]
    latest = incoming.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("chunk_id", "r.*")
    kept = stored.join(latest.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*stored.columns).unionByName(latest.select(*stored.columns))


def without_repo(chunks: DataFrame, repo: str) -> DataFrame:
    return chunks.where(F.col("repo_id") != repo)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the partitions of the repositories in `chunks`, and only those."""
    (chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path))


def mark_indexed(repos: DataFrame, done: DataFrame) -> DataFrame:
    """Set the indexed hash of the repositories listed in `done` to their commit."""
    flag = done.select("repo_id").distinct().withColumn("__done", F.lit(True))
    return repos.join(flag, "repo_id", "left").withColumn(
        "indexed_hash", F.when(F.col("__done"), F.col("commit_hash")).otherwise(F.col("indexed_hash"))).drop("__done")

"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so: after a punctuation mark and a white space that follow at least
SHORTEST characters, or after LONGEST characters. Chunks, not texts, are compared: each distinct chunk travels once
and gets a verified identifier, the hash of its text, with an ordinal where one hash stands for several texts. A text
is then its list of identifiers, a few bytes per thousand characters, and texts are equal when the lists are.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.llm.common import documents, lower_ascii, query
from logquarry.staging import stage

SHORTEST, LONGEST = 256, 2048
CHUNK = r"(?s).{%d,%d}?[.,;:!?]\s|.{1,%d}" % (SHORTEST, LONGEST, LONGEST)


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashing_chunks(pieces: DataFrame) -> DataFrame:
    """Chunks (hash, chunk) whose hash stands for several texts, with the ordinal of each; usually no row."""
    several = stage(pieces.distinct().groupBy("hash").count().where("count > 1").select("hash"), "clashing-hashes")
    if several.isEmpty():
        return pieces.limit(0).withColumn("ordinal", F.lit(0))
    by_text = Window.partitionBy("hash").orderBy("chunk")
    return pieces.join(several, "hash").distinct().withColumn("ordinal", F.row_number().over(by_text))


def recipes(docs: DataFrame, digest=chunk_hash) -> DataFrame:
    """(doc_id, text_sha256, recipe): the verified identifiers of the chunks of each text, in order.

    An identifier is the chunk's hash; where the comparison of distinct chunks finds two texts with one hash, the
    ordinal of the text among them follows it.
    """
    cut = docs.select(
        "doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text")
    ).select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    pieces = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("hash"), "chunk")
    clashes = stage(clashing_chunks(pieces), "chunk-clashes")
    if clashes.isEmpty():
        return cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: digest(c)).alias("recipe"))
    # A clash is rare: only the chunks that carry a clashing hash are looked up again, by hash and text.
    row = cut.withColumn("__row", F.struct(F.col("text_sha256"), F.size("chunks")))
    places = row.select("__row", F.posexplode("chunks").alias("at", "chunk")).withColumn("hash", digest(F.col("chunk"))).distinct()
    marks = places.join(clashes, ["hash", "chunk"]).groupBy("__row").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("at", "ordinal")))).alias("__marks"))
    identified = F.transform(
        "chunks", lambda c, i: F.struct(
            digest(c).alias("hash"), F.coalesce(F.try_element_at("__marks", i), F.lit(0)).alias("ordinal")))
    return row.join(marks, "__row", "left").select("doc_id", "text_sha256", identified.alias("recipe"))


def exact_groups(docs: DataFrame, digest=chunk_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest doc_id of the
    group, null only if all its ids are null; kept is true where the row carries that id, so rows that repeat one id
    with one text stay or go together. group_size counts rows. An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    lists = stage(recipes(docs, digest), "recipes")
    # Written, so that the join deals out the lists by itself and can split a group that many rows share.
    groups = stage(
        lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return lists.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
           FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(s) AS text_sha256
FROM t JOIN g USING (s)
"""


@query("op5_exact_dedup", SQL)
def op5(spark, folder):
    return exact_groups(documents(spark, folder))

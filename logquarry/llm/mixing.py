"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of documents in a shuffled, repeatable order, served at the rate of its target. A document's
virtual finish time is the number of its source's words up to its end, divided by the target. A source may be served
again from the start, up to `most` times its words. The queues are merged by sorting all documents by finish time over
the whole cluster and the merged stream ends where the total budget is used up. A document that is being served when
its source's share ends is taken for the words served so far, so every source comes within a word of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from logquarry.llm.common import WORD, documents, query, running_sum
from logquarry.staging import stage

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Add `target` to a table (source, source_size, ...): one row per source.

    Sources in code-point order, null last, take the weights in turn and split `share` times all words by weight. A
    target stops at `most` times the source's words, and the excess goes to the others by weight until none is above.
    The level of the others solves itself along the ratio of limit to weight: a source is held at its limit when the
    level that it and all later ones would share exceeds its own ratio.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(listed) - 1) % len(weights)
    limit = F.lit(float(most)) * F.col("source_size")
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    earlier, onward = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))) \
        / F.sum("weight").over(onward)
    held = weighed.withColumn("__level", level).withColumn("__held", F.col("__level") * F.col("weight") > limit)
    shared = F.min(F.when(~F.col("__held"), F.struct(limit / F.col("weight"), F.col("__level"))))
    return held.withColumn("__shared", shared.over(everything)).withColumn(
        "target", F.least(limit, F.coalesce(F.col("__shared.__level") * F.col("weight"), limit))
    ).drop("__level", "__held", "__shared")


def sizes(docs: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """doc_id, source, the number of words of the text, and the columns `more`."""
    return docs.select("doc_id", "source", *(more or []), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def stream(
    sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_rows: int | None = None, apart: tuple[str, ...] = (),
) -> DataFrame:
    """The mixed stream: one row per document and round, with finish, mix_start (words before it) and words.

    Input: doc_id, source, size and any other columns, which are kept. A row with no word is never in the stream, nor
    is a row whose source has no share. Ties in the shuffled order are broken by doc_id, then size, then the columns
    `apart`; rows that are equal in all may change places, with the same result. Rows without an id are shuffled by size
    and `apart`, so that they are not one block. Running sums are made over blocks of `block_rows` rows, by
    default the square root of all rows and 1000 at least, so that neither a block nor the list of blocks is long.
    """
    per_source = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    goals = stage(targets(per_source, weights, share, most), "targets").select(
        F.col("source").alias("__source"), "source_size", "target", "rows")
    count = goals.agg(F.sum("rows")).first()[0] or 0
    block_rows = block_rows or max(1000, math.isqrt(count))
    shuffled = sized.join(goals, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "__turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(
            ":", F.lit("none"), *[F.col(c).cast("string") for c in ("size", *apart)])))).drop("__source")
    # Blocks of the shuffled order: as many ranges of the leading 28 bits as the source has blocks of rows.
    lead = F.conv(F.substring("__turn", 1, 7), 16, 10).cast("long")
    block = F.floor(lead * F.ceil(F.col("rows") / block_rows) / F.lit(1 << 28))
    queued = running_sum(shuffled, ["source"], block, ["__turn", "doc_id", "size", *apart], "size", "before").drop("rows")
    rounds = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn(
        "before", F.col("before") + F.col("round") * F.col("source_size"))
    served = rounds.withColumn(
        "words", F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target") - F.col("before")))
    ).where("words > 0").withColumn("finish", (F.col("before") + F.col("words")) / F.col("target"))
    total = F.lit(share) * F.lit(goals.agg(F.sum("source_size")).scalar())
    # Finish times are spread evenly over 0..1 when counted in words, so equal ranges of them are even blocks.
    pieces = F.lit(max(1, -(-count * most // block_rows)))
    merged = running_sum(
        served, [], F.floor(F.least(F.col("finish"), F.lit(1.0)) * pieces), ["finish", "source", "__turn", "doc_id", "size", *apart],
        "words", "mix_start")
    return merged.withColumn("words", F.least(F.col("words"), F.greatest(F.lit(0), F.floor(total) - F.col("mix_start")))) \
        .where("words > 0").drop("__turn", "before")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    A null text has size 0, a null source is a source of its own. Repeated rows each have their own place. An empty
    table gives an empty result. Reruns give the same rows: the order comes from md5 of doc_id.
    """
    sized = stage(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("__copies")), "sizes")
    rows = sized.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copies")
    keys = ("doc_id", "source", "size", "__copy")
    taken = stream(rows, weights, share, most, apart=("__copy",)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("words").alias("taken"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    goals = targets(stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), weights, share, most)
    return rows.join(taken, same, "left").join(
        goals.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal"))
    ).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS lim,
        [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, (SELECT min_by(level, lim / weight) FROM l WHERE level * weight <= lim) * weight)
        AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)) AS BIGINT)
    AS taken FROM q
"""


@query("op9_fair_mixing", SQL)
def op9(spark, folder):
    return mix(documents(spark, folder))

"""Running values along an order, without putting one key into one task.

A key (a log, a conversation) may hold a large part of all rows. Rows are therefore cut into blocks of consecutive
positions. Each (key, block) is one window group of bounded size; a second, tiny table with one row per block carries
the values from block to block. Rows and carried values meet again on (key, block), where the rows already are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 16
BLOCK = "__block"


def block_of(position: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(position.cast("long"), bits)


def along(
    df: DataFrame,
    keys: list[str],
    position: str,
    *,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    ties: list[str] | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add running columns per key in the order of `position` (then `ties`).

    sums       name -> value: sum up to and including the row
    last       name -> value: greatest value up to and including the row
    following  name -> value: least value strictly after the row
    """
    sums, last, following, ties = sums or {}, last or {}, following or {}, ties or []
    source = df.withColumn(BLOCK, block_of(F.col(position), bits))
    group = Window.partitionBy(*keys, BLOCK)
    before = group.orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = group.orderBy(F.desc(position), *[F.desc(t) for t in ties]).rowsBetween(Window.unboundedPreceding, -1)

    totals = source.groupBy(*keys, BLOCK).agg(
        *[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"__t_{n}") for n, v in last.items()],
        *[F.min(v).alias(f"__t_{n}") for n, v in following.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in last],
        *[F.min(f"__t_{n}").over(later).alias(f"__c_{n}") for n in following],
    )
    local = source.select(
        "*",
        *[F.sum(v).over(before).alias(f"__l_{n}") for n, v in sums.items()],
        *[F.max(v).over(before).alias(f"__l_{n}") for n, v in last.items()],
        *[F.min(v).over(after).alias(f"__l_{n}") for n, v in following.items()],
    )
    joined = local.join(carried, [*keys, BLOCK])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.col(f"__c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"__l_{n}", f"__c_{n}").alias(n) for n in last],
        *[F.least(f"__l_{n}", f"__c_{n}").alias(n) for n in following],
    )


def islands(df: DataFrame, keys: list[str], position: str, value: str, out: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Number the runs of equal `value` along `position`, from 1 within each key."""
    source = df.withColumn(BLOCK, block_of(F.col(position), bits))
    order = Window.partitionBy(*keys, BLOCK).orderBy(position)
    changed = source.withColumn(
        "__change", F.when(F.lag(value).over(order) != F.col(value), 1).otherwise(0))
    local = changed.withColumn(
        "__island", F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = local.groupBy(*keys, BLOCK).agg(
        F.min_by(value, position).alias("__first"), F.max_by(value, position).alias("__final"),
        F.max("__island").alias("__changes"))
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    fresh = edges.withColumn(
        "__opens", F.when(F.lag("__final").over(blocks) == F.col("__first"), 0).otherwise(1))
    carried = fresh.select(
        *keys, BLOCK,
        (F.coalesce(F.sum(F.col("__changes") + F.col("__opens")).over(
            blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__opens")).alias("__base"))
    return local.join(carried, [*keys, BLOCK]).select(
        *[F.col(c) for c in df.columns], (F.col("__island") + F.col("__base")).cast("long").alias(out))


def sorted_ranges(df: DataFrame, order: list[Column], out: str = "__range") -> DataFrame:
    """`df` sorted into ranges of `order`, with the number of its range: a key of any size is spread over tasks. The
    result has to be written before the ranges are used, so that they are the same in every use."""
    return df.repartitionByRange(*order).withColumn(out, F.spark_partition_id())


def before(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str], at: str = "__range") -> DataFrame:
    """Add sums (name -> column) over the earlier rows of the same keys of written ranges. Each (keys, range) is a window
    group; one row per group carries the sums on."""
    inside = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, at).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    carried = totals.select(*[F.col(k).alias(f"__k_{k}") for k in (*keys, at)], *[
        F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in values])
    local = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__l_{n}") for n, v in values.items()])
    same = F.lit(True)
    for k in (*keys, at):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return local.join(carried, same).select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__c_{n}")).alias(n) for n in values])

"""Rows from arrays."""

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, keep: list, items: Column | str, value: str, position: str = "__at") -> DataFrame:
    """One row per element with its position.

    An inner explode makes the optimizer test the array for elements below every earlier projection, which computes a
    costly array twice. The outer form has no such test; the row it adds for an empty array is dropped here.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, value)).where(F.col(position).isNotNull())
    return rows.drop(position) if position == "__at" else rows

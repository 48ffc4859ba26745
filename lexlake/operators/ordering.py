"""Positions and running sums within a key without sending a key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sum_before(df: DataFrame, key: str, ordinal: str, size: Column, name: str, width: int = 1 << 20) -> DataFrame:
    """Sum of ``size`` over the earlier rows of ``key`` by a unique integer ``ordinal``.

    Rows are summed within stretches of ``width`` ordinals; the totals of the
    earlier stretches of the key are added.  A stretch holds at most ``width``
    rows however many rows the key has.  Ordinals should count rows (small gaps do
    no harm): the number of stretches is the largest ordinal over ``width``.
    """
    cut = df.withColumns({"_stretch": F.floor(F.col(ordinal) / F.lit(width)).cast("long"), "_size": size})
    totals = cut.groupBy(key, "_stretch").agg(F.sum("_size").alias("_total"))
    earlier = W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(key, "_stretch", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, "_stretch").orderBy(ordinal).rowsBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = summed.join(offsets, [key, "_stretch"]).withColumn(name, F.col("_before") + F.col("_inside"))
    return out.drop("_stretch", "_size", "_before", "_inside")


def position_in_key(df: DataFrame, key: str, ordinal: str, name: str, width: int = 1 << 20) -> DataFrame:
    """1-based position of every row within ``key`` by a unique integer ``ordinal``."""
    return sum_before(df, key, ordinal, F.lit(1), name, width).withColumn(name, F.col(name) + 1)

"""Connected components of links as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the root is the least node that
    can be reached.  Roots have no row for themselves.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones,
    on the least node it knows.  A few rounds are enough whatever the shape, nothing
    but two numbers comes to the driver, and each round is a stored table.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    held = stored(links.select(a.alias("a"), b.alias("b")).filter("a < b").distinct(), "links")
    before = None
    while True:
        same = held.select(F.xxhash64("a", "b").cast("decimal(38,0)").alias("x")).agg(F.count("*").alias("n"), F.sum("x").alias("x")).first()
        if same == before:
            return held.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = same
        ends = held.select(F.col("a").alias("node"), F.col("b").alias("other")).union(held.select("b", "a"))
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        hung = held.join(least, F.col("a") == F.col("node")).select(F.col("m").alias("a"), "b").distinct()
        lowest = hung.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
        small = hung.join(lowest, F.col("b") == F.col("node"))
        moved = small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
        held = stored(moved.union(lowest.select("m", "node")).distinct(), "links")

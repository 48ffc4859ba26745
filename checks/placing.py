"""Makes an order visible: twins compare rows, not their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks.scratch import scratch


def global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based position of every row in ``order``.

    A range-partitioned sort gives each task a contiguous stretch, which is stored with
    the number of its task and of the row there; the rows of the tasks before are added.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/ordered"
    numbered = df.orderBy(*order).withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    numbered.write.parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    tasks = stored.groupBy("_task").count().select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(tasks), "_task").select(*df.columns, (F.col("_before") + inside + 1).cast("long").alias(name))

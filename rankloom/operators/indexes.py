"""Dense integers for values of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialise


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of ``column`` with dense integers from 0, in their order.

    Values are dealt by ranges. Every task numbers its own rows; the offset of a task is the number of
    rows before it, from a table of one row per task. The numbers are written
    once, so every later reader sees the same ones.
    """
    numbered = materialise(
        df.select(column)
        .distinct()
        .repartitionByRange(column)
        .sortWithinPartitions(column)
        .select(
            column,
            F.spark_partition_id().alias("task"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        ),
        name,
    )
    counts = numbered.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))  # one row per task
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(offsets, "task").select(column, (F.col("before") + F.col("place")).cast("int").alias("index"))

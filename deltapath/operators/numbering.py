"""Consecutive numbers for sorted rows, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with their place from 0 in the given order (which must be a key of the rows).

    Rows are sorted within ranges of the order and written with their place in
    the range; the ranges' first numbers come from a table with one row per
    range, so no task holds more than a range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    dealt, _ = write_frontier(dealt, "ranges")
    parts = dealt.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    out = dealt.join(F.broadcast(parts), "__part")  # as many rows as shuffle partitions
    return out.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__base")).alias(name))

"""Generated graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..plans.lineage import write_frontier


def nary_tree(spark: SparkSession, n: int, degree: int) -> DataFrame:
    """Edges of the ``degree``-ary tree on vertices ``0 .. n-1`` numbered breadth first.

    The breadth-first queue walk has a closed form: vertex ``c >= 1`` hangs
    under ``(c - 1) div degree``; all weights are 1.0.  ``n <= 1`` or
    ``degree <= 0`` gives no edges.  Rows come from a distributed range.
    """
    n = int(n)
    degree = int(degree)
    ids = spark.range(1, max(n, 1))
    if degree <= 0:
        ids = ids.where(F.lit(False))
    step = max(degree, 1)
    return ids.select(
        F.expr(f"(id - 1) div {step}").cast("bigint").alias("src"),
        F.col("id").cast("bigint").alias("dst"),
        F.lit(1.0).alias("weight"),
    )


def tree_over(rows: DataFrame, key: str, degree: int) -> DataFrame:
    """The ``degree``-ary tree whose vertices are ``rows``, breadth first in the order of their unique ``key``.

    Edges lead from the parent's key to the child's, all weights are 1.0.
    """
    if degree <= 0:
        return rows.where(F.lit(False)).select(F.col(key).cast("bigint").alias("src"), F.col(key).cast("bigint").alias("dst"), F.lit(1.0).alias("weight"))
    nodes, _ = write_frontier(numbered(rows.select(F.col(key).cast("bigint").alias("key")), "key"), "tree")
    children = nodes.where("number > 0").select(F.expr(f"(number - 1) div {int(degree)}").alias("number"), F.col("key").alias("dst"))
    parents = nodes.select("number", F.col("key").alias("src"))
    return children.join(parents, "number").select("src", "dst", F.lit(1.0).alias("weight"))

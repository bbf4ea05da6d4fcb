"""Block comparisons of nodes of different components that meet in buckets.

The nodes of a bucket are dealt into blocks, and pairs of blocks are groups of
their own, so no task holds a bucket.  A component with a large part of a
bucket is never put against itself: its nodes are one side of a comparison
with the outsiders that they meet, once for all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .common import sized

#: Tables of numbers up to so many rows (of under 100 bytes) are broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of a block's sets or texts, about; a longer one is a block of its own.
BLOCK_BYTES = 4 << 20
#: A bucket (or a component, against its outsiders), and two of its blocks.
GROUP_COLUMNS = ("token", "inside", "i", "j")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sides_of(rest: DataFrame, group: int) -> DataFrame:
    """Rows (token, node, component, base, upper, bytes) of mixed buckets, for ``dealt``.

    A component with over ``group`` nodes in a bucket leaves it: its nodes in
    such buckets are one side of a comparison with all outsiders that they meet
    there.  The other rows of a bucket are compared among themselves.
    """
    rest, n_rest = write_frontier(rest, "rest")
    sizes = sized(rest.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")), n_rest)
    large, n = write_frontier(sizes.where(F.col("c") > group).select("token", F.col("component").alias("whose")), "large")
    inside = rest.withColumns({"inside": F.lit(True), "side": F.lit(0)})
    if not n:
        return inside
    met = rest.join(bounded(large, n), "token")
    own = (F.col("component") == F.col("whose")).alias("own")
    # Two components that are large somewhere are compared on both sides, as they may meet where only one of them is.
    met = met.select(F.col("whose").alias("token"), own, "node", "component", "bytes").distinct()
    met = met.select("token", "node", "component", F.lit(0).cast("bigint").alias("base"), F.lit(True).alias("upper"), "bytes", F.lit(False).alias("inside"), F.when(F.col("own"), 0).otherwise(1).alias("side"))
    gone = large.withColumnRenamed("whose", "component")
    inside = inside.join(bounded(gone, n), ["token", "component"], "left_anti")
    return inside.select("token", "node", "component", "base", "upper", "bytes", "inside", "side").unionByName(met)


def dealt(sides: DataFrame, group: int) -> DataFrame:
    """Rows (token, inside, side, node, component, base, upper, bytes) in all pairs of blocks that have to be compared.

    ``inside``: the rows of a bucket among themselves; else the two sides of a
    component, its nodes and their outsiders.
    """

    def blocks(k: int) -> Column:
        size = F.sum(F.when(F.col("side") == k, F.col("bytes"))) / BLOCK_BYTES
        return F.ceil(F.greatest(F.count_if(F.col("side") == k) / group, F.coalesce(size, F.lit(0.0)))).cast("int").alias(f"n{k}")

    sides, n_sides = write_frontier(sides, "sides")
    sizes = sides.groupBy("token", "inside").agg(*[blocks(k) for k in (0, 1)])
    sizes, n = write_frontier(sized(sizes, n_sides), "sizes")
    rows = sides.join(bounded(sizes, n), ["token", "inside"]).where("inside or (n0 > 0 and n1 > 0)")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    keep = ["node", "component", "base", "upper"]
    first = rows.where("side = 0")
    to = F.when(F.col("inside"), F.sequence(F.col("block"), F.col("n0") - 1)).otherwise(F.sequence(F.lit(0), F.col("n1") - 1))
    left = first.select("token", "inside", F.col("block").alias("i"), F.explode(to).alias("j"), F.lit(True).alias("left"), *keep)
    below = first.where("inside and block > 0").select("token", "inside", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), *keep)
    other = rows.where("side = 1").select("token", "inside", F.explode(F.sequence(F.lit(0), F.col("n0") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), *keep)
    return left.unionByName(below).unionByName(other)

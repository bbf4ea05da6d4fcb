"""Connected components of links between long ids, by alternating star contractions.

Each round points every node at the least node around it; the number of
rounds grows with the logarithm of a component's diameter.  Minima are
aggregated before the shuffle, so a node with very many links costs one row
per task; its links take the minimum from a broadcast table, as there are few
such nodes.  Every round is written, which cuts the lineage, in partitions for
its number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .common import sized


#: Minima of up to so many nodes are broadcast to the links.
BROADCAST_ROWS = 200_000


def _with_least(rows: DataFrame, own: bool, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (u, v) with ``m``, the least ``v`` of their ``u`` (or ``u`` itself if ``own``), and the table (u, m)."""
    m = F.least(F.col("u"), F.min("v")) if own else F.min("v")
    least, n = write_frontier(sized(rows.groupBy("u").agg(m.alias("m"), F.count(F.lit(1)).alias("c")), n_rows), "least")
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least.drop("c")), "u"), least
    # Nodes with more links than this are no more than may be broadcast.
    floor = max(1000, -(-n_rows // BROADCAST_ROWS))
    hot = F.broadcast(least.where(F.col("c") > floor).drop("c"))
    cold = rows.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("c") <= floor).drop("c"), "u")
    return rows.join(hot, "u").unionByName(cold), least


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows, _ = _with_least(both, True, 2 * n)
    return rows.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows, least = _with_least(down, False, n)
    moved = rows.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; ``links``: (u, v); a component is named by its least node."""
    links, n = write_frontier(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if state == before or not state[0]:
            break
        before = state
        large, n = write_frontier(sized(_large_star(links, n).distinct(), 2 * n), "links")
        links, n = write_frontier(sized(_small_star(large, n).distinct(), 2 * n), "links")
    both = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return sized(both.distinct(), 2 * n)

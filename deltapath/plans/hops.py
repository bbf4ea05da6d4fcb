"""Hop-staged distances: the smallest weight of a walk of exactly ``k`` edges.

Stage ``k`` is computed only from stage ``k - 1`` (not min'ed with older
stages), which is what a synchronous stage loop that replaces each vertex's
value by the min of that stage's messages computes.  On a tree this is the
shortest distance of every vertex at depth ``k``.
"""

from __future__ import annotations

from functools import reduce as _reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.adjacency import DEFAULT_BROADCAST_ROWS, DEFAULT_MIN_HOT_ROWS, Adjacency
from ..operators.changes import edge_delta
from ..operators.graph import prepare_edges
from ..session import num_partitions
from .lineage import persist, write_frontier
from .sssp import RunStats

DEFAULT_MAX_HOPS = 10


def _source_stage(spark, source: int) -> DataFrame:
    return spark.range(1).select(F.lit(source).cast("bigint").alias("v"), F.lit(0.0).alias("d"))


def _union_stages(stages: list[DataFrame]) -> DataFrame:
    return _reduce(lambda a, b: a.unionByName(b), stages)


def hop_distances(
    edges: DataFrame,
    source: int = 0,
    max_hops: int = DEFAULT_MAX_HOPS,
    validate: bool = True,
    partitions: int | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
    stats: RunStats | None = None,
    adjacency: Adjacency | None = None,
    collapse: bool = True,
) -> DataFrame:
    """``(v, k, d)`` for k = 1..max_hops: min weight over walks of exactly k edges.

    A layout of the edges that is there already (``adjacency``) is used and kept.
    ``collapse``: False for edges that have no parallel ones.
    """
    spark = edges.sparkSession
    n = num_partitions(spark, partitions)
    stats = stats if stats is not None else RunStats()
    own = adjacency is None
    if adjacency is None:
        adjacency = Adjacency.build(prepare_edges(edges, validate, collapse), "src", "dst", n, broadcast_rows, min_hot_rows)
    stage = _source_stage(spark, source)
    rows = 1
    stages: list[DataFrame] = []
    for k in range(1, max_hops + 1):
        if rows == 0:
            break
        expanded = adjacency.expand(stage.select(F.col("v").alias("src"), "d"), rows)
        nxt = expanded.groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("weight")).alias("d"))
        # Each stage is written to the shared folder and read back as a leaf:
        # the final union then holds ten independent scans, not ten nested plans.
        stage, rows = write_frontier(nxt, "hop-stage")
        stats.frontier_sizes.append(rows)
        stats.rounds = k
        if rows:
            stages.append(stage.select("v", F.lit(k).alias("k"), "d"))
    if own:
        adjacency.release()
    if not stages:
        return spark.range(0).select(
            F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("k"), F.lit(0.0).alias("d")
        )
    result, _ = write_frontier(_union_stages(stages), "hop-result")
    return result


def last_stage_distance(hops: DataFrame) -> DataFrame:
    """Distance of the last stage in which each vertex was reached -> ``(v, d)``."""
    return hops.groupBy("v").agg(F.max_by("d", "k").alias("d"))


def stage_message_counts(hops: DataFrame) -> DataFrame:
    """Number of receiving vertices per stage -> ``(k, n)``."""
    return hops.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def stage_messages(edges: DataFrame, hops: DataFrame, source: int = 0, max_hops: int = DEFAULT_MAX_HOPS) -> DataFrame:
    """Every message of every stage -> ``(dst, src, k, msg)``, rebuilt from the hop table."""
    spark = edges.sparkSession
    senders = hops.select("v", "k", "d").unionByName(
        _source_stage(spark, source).select("v", F.lit(0).alias("k"), "d")
    ).where(F.col("k") < F.lit(max_hops))
    e = prepare_edges(edges, validate=False)
    joined = e.join(senders.withColumnRenamed("v", "src"), "src", "inner")
    return joined.select("dst", "src", (F.col("k") + 1).alias("k"), (F.col("d") + F.col("weight")).alias("msg"))


def update_hop_distances(
    hops: DataFrame,
    old_edges: DataFrame,
    new_edges: DataFrame,
    source: int = 0,
    max_hops: int = DEFAULT_MAX_HOPS,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
    stats: RunStats | None = None,
) -> DataFrame:
    """Re-stage after an edge change, from two edge tables; :func:`hops_after_changes` takes a layout and its delta."""
    adjacency = Adjacency.build(prepare_edges(old_edges), "src", "dst", None, broadcast_rows, min_hot_rows)
    delta = write_frontier(edge_delta(adjacency.base, prepare_edges(new_edges)), "hop-delta")
    out, _ = hops_after_changes(hops, adjacency, *delta, source, max_hops, stats)
    adjacency.release()
    return out


def hops_after_changes(
    hops: DataFrame,
    adjacency: Adjacency,
    delta: DataFrame,
    n_delta: int,
    source: int = 0,
    max_hops: int = DEFAULT_MAX_HOPS,
    stats: RunStats | None = None,
) -> tuple[DataFrame, Adjacency]:
    """The hop table after changed edges ``(src, dst, old_w, new_w)``, and the patched layout.

    Stage ``k`` of vertex ``v`` is recomputed only if an in-edge of ``v``
    changed and its sender had a stage ``k - 1`` value (before or after), or
    an in-neighbour's stage ``k - 1`` value changed.  All other rows are copied
    from ``hops``.  Changed vertices push to their out-neighbours through the
    layout by ``src``, the receivers pull their in-edges through the one by
    ``dst``: neither shuffles the edges, and a hub's edges are spread out in
    both.  The result equals :func:`hop_distances` on the new edges.
    """
    spark = hops.sparkSession
    stats = stats if stats is not None else RunStats()
    bound = adjacency.broadcast_rows
    after = adjacency.patched(delta.select("src", "dst", F.col("new_w").alias("weight")), n_delta) if n_delta else adjacency

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= bound else df

    hops = persist(hops.select("v", "k", "d"))
    heads = delta.select(F.col("src").alias("v")).distinct()
    prev_old = prev_new = _source_stage(spark, source)
    n_new = 1
    changed, n_changed = None, 0
    stages: list[DataFrame] = []
    for k in range(1, max_hops + 1):
        old_k = hops.where(F.col("k") == F.lit(k)).select("v", "d")
        # Changed edges whose sender has or had a value: a look-up of the delta's sources.
        senders = prev_old.select("v").unionByName(prev_new.select("v")).join(small(heads, n_delta), "v", "left_semi").distinct()
        affected = delta.join(small(senders.withColumnRenamed("v", "src"), n_delta), "src", "left_semi").select(F.col("dst").alias("v"))
        if n_changed:
            pushed = after.expand(changed.select(F.col("v").alias("src")), n_changed)
            affected = affected.unionByName(pushed.select(F.col("dst").alias("v")))
        # Small per-stage tables are written to the shared folder and read back:
        # each is then a leaf, so stage plans do not nest across stages.
        affected, n_aff = write_frontier(affected.distinct(), "hop-affected")
        if n_aff == 0:
            new_k, n_new = old_k, None
            changed, n_changed = None, 0
        else:
            pulled = after.into(affected.select(F.col("v").alias("dst")), n_aff).select("src", "dst", "weight")
            values = prev_new.select(F.col("v").alias("src"), F.col("d").alias("s_d"))
            offers = pulled.join(small(values, n_new) if n_new is not None else values, "src", "inner")
            recomputed = offers.groupBy(F.col("dst").alias("v")).agg(F.min(F.col("s_d") + F.col("weight")).alias("d"))
            recomputed, _ = write_frontier(recomputed, "hop-recomputed")
            aff = small(affected, n_aff)
            new_k, n_new = write_frontier(old_k.join(aff, "v", "left_anti").unionByName(recomputed), "hop-stage")
            before = old_k.join(aff, "v", "left_semi").select("v", F.col("d").alias("old_d"))
            cmp = recomputed.join(before, "v", "full_outer")
            changed, n_changed = write_frontier(cmp.where(~F.col("d").eqNullSafe(F.col("old_d"))).select("v"), "hop-changed")
        stats.frontier_sizes.append(n_aff)
        stages.append(new_k.select("v", F.lit(k).alias("k"), "d"))
        prev_old, prev_new = old_k, new_k
    stats.rounds = max_hops
    result, _ = write_frontier(_union_stages(stages), "hop-result")
    hops.unpersist(blocking=False)
    return result, after

"""Shortest distances after edge changes, and what a change disturbed, from DataFrames.

The previous state ``(v, d, parent)`` and the edges go in, the new ones come
out; the work is that of :mod:`deltapath.plans.live`, which also keeps the
edge layout for further batches.  Invalidation below raised or deleted edges
comes first, which makes raises exact on zero-weight and short positive
cycles, where re-sent messages would climb one cycle length per round or
never settle; relaxation from the best offers follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.adjacency import DEFAULT_BROADCAST_ROWS
from ..operators.changes import edge_delta
from ..operators.graph import prepare_edges
from ..operators.messages import memo_table
from .lineage import write_frontier
from .live import LiveDistances
from .sssp import RunStats


def _maybe_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    return F.broadcast(df) if rows <= bound else df


def update_sssp(
    prev: DataFrame,
    old_edges: DataFrame,
    new_edges: DataFrame,
    source: int = 0,
    validate: bool = True,
    stats: RunStats | None = None,
    delta: DataFrame | None = None,
    **layout,
) -> DataFrame:
    """New ``(v, d, parent)`` for ``new_edges`` from ``prev`` computed on ``old_edges``.

    ``delta`` holds the edges that differ, ``(src, dst, old_w, new_w)``;
    without it the two edge tables are prepared and compared.  One call lays
    the edges out; for a series of batches keep a :class:`LiveDistances`.
    """
    live = LiveDistances.build(old_edges, source, validate=False, state=prev, **layout)
    if delta is None:
        delta = edge_delta(live.edges(), prepare_edges(new_edges, validate))
    change = live.change(*write_frontier(delta.select("src", "dst", "old_w", "new_w"), "delta"))
    if stats is not None:
        stats.rounds, stats.frontier_sizes, stats.extra = change.stats.rounds, change.stats.frontier_sizes, change.stats.extra
    return change.after.state


def sssp_after_update(prev: DataFrame, edges: DataFrame, updates: DataFrame, source: int = 0, **layout) -> tuple[DataFrame, DataFrame]:
    """Apply weight updates (last by ``seq``; unknown keys ignored) and update distances.

    Returns ``(new_edges, new_state)``.
    """
    after = LiveDistances.build(edges, source, state=prev, **layout).update(updates).after
    return after.edges(), after.state


def sssp_after_upsert(prev: DataFrame, edges: DataFrame, updates: DataFrame, source: int = 0, **layout) -> tuple[DataFrame, DataFrame]:
    """Update known edges and insert unknown ones, then update distances."""
    after = LiveDistances.build(edges, source, state=prev, **layout).upsert(updates).after
    return after.edges(), after.state


def changed_memo(old_edges: DataFrame, old_dist: DataFrame, new_edges: DataFrame, new_dist: DataFrame) -> DataFrame:
    """Memo rows ``(dst, src)`` whose message differs between two fixpoints (NULL-safe)."""
    old = memo_table(prepare_edges(old_edges, validate=False), old_dist).select("dst", "src", F.col("msg").alias("old_msg"))
    new = memo_table(prepare_edges(new_edges, validate=False), new_dist).select("dst", "src", F.col("msg").alias("new_msg"))
    joined = old.join(new, ["dst", "src"], "full_outer")
    return joined.where(~F.col("old_msg").eqNullSafe(F.col("new_msg"))).select("dst", "src", "old_msg", "new_msg")


def disturbed_vertices(
    old_edges: DataFrame,
    old_dist: DataFrame,
    new_edges: DataFrame,
    new_dist: DataFrame,
    delta: DataFrame | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Vertices that received a different message between two runs -> ``(v)``.

    Same result as comparing the two memo tables row by row
    (:func:`changed_memo`), but only edges that can carry a different message
    are looked at: out-edges of vertices whose distance changed, and edges
    whose weight changed (``delta``: ``(src, dst)`` keys, computed from the two
    edge tables when not given, e.g. from an update batch).
    """
    eo = prepare_edges(old_edges, validate=False)
    en = prepare_edges(new_edges, validate=False)
    dists = old_dist.select("v", F.col("d").alias("d_old")).join(
        new_dist.select("v", F.col("d").alias("d_new")), "v", "full_outer"
    )
    moved, n_moved = write_frontier(dists.where(~F.col("d_old").eqNullSafe(F.col("d_new"))).select(F.col("v").alias("src")), "moved")
    moved = _maybe_broadcast(moved, n_moved, broadcast_rows)
    if delta is None:
        delta = edge_delta(eo, en)
    keys = (
        eo.select("src", "dst").join(moved, "src", "left_semi")
        .unionByName(en.select("src", "dst").join(moved, "src", "left_semi"))
        .unionByName(delta.select("src", "dst"))
        .distinct()
    )
    keys, n_keys = write_frontier(keys, "disturb-keys")
    k = _maybe_broadcast(keys, n_keys, broadcast_rows)

    def messages(edges: DataFrame, dist: DataFrame, name: str) -> DataFrame:
        senders = dist.where(F.col("d").isNotNull()).select(F.col("v").alias("src"), "d")
        on_keys = edges.join(k, ["src", "dst"], "left_semi")
        return on_keys.join(senders, "src", "inner").select("src", "dst", (F.col("d") + F.col("weight")).alias(name))

    cmp = messages(eo, old_dist, "old_msg").join(messages(en, new_dist, "new_msg"), ["src", "dst"], "full_outer")
    return cmp.where(~F.col("old_msg").eqNullSafe(F.col("new_msg"))).select(F.col("dst").alias("v")).distinct()


def disturbed_flags(state: DataFrame, disturbed: DataFrame) -> DataFrame:
    """``state`` plus ``disturbed`` = 1 for disturbed vertices, else 0."""
    mark = disturbed.select("v", F.lit(1).alias("hit"))
    return state.join(mark, "v", "left").withColumn("disturbed", F.coalesce(F.col("hit"), F.lit(0))).drop("hit")


def count_disturbed(disturbed: DataFrame) -> DataFrame:
    """One row ``(n)``: number of disturbed vertices (0 on an empty graph)."""
    return disturbed.agg(F.count(F.lit(1)).alias("n"))

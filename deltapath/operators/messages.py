"""Message passing as joins and aggregates.

The memo of a vertex -- the last message it got from each in-neighbour -- is
kept as rows ``memo(dst, src, msg)``, never as a map, so merging two digests
is a keyed upsert and "min of the digest" is a grouped ``min``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import message
from ..plans.lineage import write_frontier
from .adjacency import Adjacency

Send = Callable[[Column, Column], Column]
Reduce = Callable[[Column], Column]


def candidate_messages(edges: DataFrame | Adjacency, state: DataFrame, send: Send = message) -> DataFrame:
    """Every reached sender's message on each of its out-edges -> ``(dst, src, msg)``.

    Unreached senders (``d`` NULL) send nothing.  ``state`` has one row per
    vertex; a skewed ``src`` is split by AQE's skew-join handling.  Edges that
    are laid out are not shuffled.
    """
    senders = state.where(F.col("d").isNotNull()).select(F.col("v").alias("src"), F.col("d").alias("src_d"))
    if isinstance(edges, Adjacency):
        joined = edges.expand(*write_frontier(senders, "senders"))
    else:
        joined = edges.join(senders, "src", "inner")
    return joined.select("dst", "src", send(F.col("src_d"), F.col("weight")).alias("msg"))


def aggregate_messages(messages: DataFrame, reduce: Reduce = F.min, name: str = "msg") -> DataFrame:
    """Combine the messages of each destination -> ``(v, <name>)`` (partial + final aggregate)."""
    return messages.groupBy(F.col("dst").alias("v")).agg(reduce(F.col("msg")).alias(name))


def memo_table(edges: DataFrame | Adjacency, dist: DataFrame) -> DataFrame:
    """Memo rows at a fixpoint: the current message of every reached in-neighbour."""
    return candidate_messages(edges, dist)


def min_message(memo: DataFrame, source: int | None = None) -> DataFrame:
    """Distance implied by a memo: the smallest remembered message -> ``(v, d)``.

    A vertex with no messages gets no row; the source (if given) stays 0.
    """
    best = memo.groupBy(F.col("dst").alias("v")).agg(F.min("msg").alias("d"))
    if source is None:
        return best
    return best.select("v", F.when(F.col("v") == F.lit(source), F.lit(0.0)).otherwise(F.col("d")).alias("d"))


def changed_messages(candidates: DataFrame, memo: DataFrame) -> DataFrame:
    """Candidates that differ from what the receiver remembers from that sender (NULL-safe)."""
    old = memo.select("dst", "src", F.col("msg").alias("old_msg"))
    joined = candidates.join(old, ["dst", "src"], "left")
    return joined.where(~F.col("msg").eqNullSafe(F.col("old_msg"))).select("dst", "src", "msg")


def merge_memo(memo: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert ``incoming`` messages into ``memo`` by ``(dst, src)``; incoming wins."""
    new = incoming.select("dst", "src", F.col("msg").alias("new_msg"))
    joined = memo.join(new, ["dst", "src"], "full_outer")
    return joined.select("dst", "src", F.coalesce(F.col("new_msg"), F.col("msg")).alias("msg"))


def vertex_step(state: DataFrame, incoming: DataFrame, merged_memo: DataFrame, source: int = 0) -> DataFrame:
    """Receivers of ``incoming`` recompute ``d`` as the min of their merged memo -> ``(v, d)``.

    Only receivers get a row (the inner join of the vertex program); the source
    keeps 0.
    """
    receivers = incoming.select(F.col("dst").alias("v")).distinct()
    recomputed = min_message(merged_memo.join(receivers.withColumnRenamed("v", "dst"), "dst", "left_semi"), source)
    return state.select("v").join(receivers, "v", "inner").join(recomputed, "v", "left")


def merge_state(state: DataFrame, stepped: DataFrame) -> DataFrame:
    """Receivers take their new distance, everyone else keeps the old one -> ``(v, d)``."""
    new = stepped.select("v", F.col("d").alias("new_d"), F.lit(True).alias("got"))
    joined = state.join(new, "v", "left")
    return joined.select("v", F.when(F.col("got"), F.col("new_d")).otherwise(F.col("d")).alias("d"))


def active_frontier(state: DataFrame, stepped: DataFrame) -> DataFrame:
    """Receivers whose distance changed: they propagate in the next round -> ``(v, d)``."""
    old = state.select("v", F.col("d").alias("old_d"))
    joined = stepped.join(old, "v", "inner")
    return joined.where(~F.col("d").eqNullSafe(F.col("old_d"))).select("v", "d")

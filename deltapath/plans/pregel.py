"""Generic iterative message passing to a fixpoint (the Pregel pattern) on DataFrames.

The caller gives three Column functions: ``send(sender_value, weight)`` builds
the message on an edge, ``reduce(msg)`` is the aggregate that combines the
messages of one receiver (it must be associative, so Spark can combine
map-side), and ``update(old_value, combined)`` is the vertex program.  A
vertex whose value changes is active in the next round; the loop stops when
no value changes.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import message
from ..operators.adjacency import DEFAULT_BROADCAST_ROWS, DEFAULT_MIN_HOT_ROWS, Adjacency
from ..operators.graph import validate_edges
from ..session import num_partitions
from .lineage import Generations, cut, persist, write_frontier
from .sssp import DEFAULT_CHECKPOINT_INTERVAL, RunStats


class NotConverged(RuntimeError):
    """A round limit was reached while vertices were still active."""


def _least(old: Column, msg: Column) -> Column:
    return F.least(old, msg)


def pregel(
    edges: DataFrame,
    initial: DataFrame,
    send: Callable[[Column, Column], Column] = message,
    reduce: Callable[[Column], Column] = F.min,
    update: Callable[[Column, Column], Column] = _least,
    max_rounds: int | None = None,
    validate: bool = True,
    partitions: int | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
    checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL,
    stats: RunStats | None = None,
    allow_partial: bool = False,
) -> DataFrame:
    """Run to a fixpoint from ``initial(v, value)``; rows with a value start active.

    Returns ``(v, value)`` for every vertex of ``initial``.  If vertices are
    still active after ``max_rounds``, :class:`NotConverged` is raised, unless
    the caller asks for the state as it is (``allow_partial``).
    """
    spark = edges.sparkSession
    n = num_partitions(spark, partitions)
    stats = stats if stats is not None else RunStats()
    e = validate_edges(edges.select("src", "dst", "weight")) if validate else edges.select("src", "dst", "weight")
    adjacency = Adjacency.build(e, "src", "dst", n, broadcast_rows, min_hot_rows)
    state = cut(
        initial.select("v", "value", F.col("value").isNotNull().alias("fresh")).repartition(n, "v")
    )
    gens = Generations()
    gens.hold(state)
    frontier, active = write_frontier(
        state.where(F.col("fresh")).select(F.col("v").alias("src"), F.col("value").alias("s_value"))
    )
    done = 0
    while active > 0 and (max_rounds is None or done < max_rounds):
        expanded = adjacency.expand(frontier, active)
        combined = expanded.groupBy(F.col("dst").alias("v")).agg(
            reduce(send(F.col("s_value"), F.col("weight"))).alias("msg")
        )
        joined = state.join(combined.hint("shuffle_hash"), "v", "left")
        new_value = F.when(F.col("msg").isNotNull(), update(F.col("value"), F.col("msg"))).otherwise(F.col("value"))
        nxt = joined.select("v", new_value.alias("value"), F.col("value").alias("old"))
        nxt = nxt.select("v", "value", (~F.col("value").eqNullSafe(F.col("old"))).alias("fresh"))
        done += 1
        nxt = cut(nxt) if done % checkpoint_interval == 0 else persist(nxt)
        state = gens.hold(nxt)
        frontier, active = write_frontier(
            state.where(F.col("fresh")).select(F.col("v").alias("src"), F.col("value").alias("s_value"))
        )
        stats.frontier_sizes.append(active)
    stats.rounds = done
    if active > 0 and not allow_partial:
        raise NotConverged(f"{active} vertices still active after {done} rounds")
    # Cached and materialised by the last frontier write; lineage bounded by
    # the last checkpoint and the written frontier tables.
    gens.release_except(state)
    adjacency.release()
    return state.select("v", "value")

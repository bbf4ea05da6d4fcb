"""Single-source shortest distances as a frontier relaxation loop over DataFrames.

State ``dist(v, d, parent)`` holds every vertex (``d`` NULL = unreachable),
hash-partitioned by ``v`` once.  One round:

1. ``frontier ⋈ edges`` through the prepared :class:`Adjacency` (broadcast
   when the counted frontier is small, otherwise a salted shuffle of the
   frontier only);
2. ``groupBy(dst).min(struct(d + weight, src))`` -- partial aggregation first,
   so a hot destination costs one row per map task;
3. join with ``dist`` on the same hash partitioning (no shuffle of ``dist``),
   keep strict improvements -> next frontier, counted (one action per round);
4. ``dist ⟕ improvements`` on the same partitioning, coalesce.

The source is pinned at 0: weights are >= 0, so no message can strictly
improve it.  ``parent`` only changes on a strict decrease, so the parents form
a shortest-path forest that the incremental update uses for invalidation.
The loop ends when no vertex improves (no fixed stage count).

On a deep graph nearly all of a round is the cost of a job, not of its rows.
A run that has not ended after ``STEPWISE_ROUNDS`` rounds takes
``HOPS_PER_JOB`` hops in each job from then on (:class:`DeepHops`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import best_message, message
from ..operators.adjacency import DEFAULT_BROADCAST_ROWS, DEFAULT_MIN_HOT_ROWS, Adjacency
from ..operators.graph import prepare_edges, vertices_from_edges, with_source
from ..session import num_partitions
from .lineage import Generations, cut, persist, write_frontier, write_table

DEFAULT_CHECKPOINT_INTERVAL = 8
#: Rounds of one hop before a run counts as deep, and the hops that a job takes from then on.
STEPWISE_ROUNDS, HOPS_PER_JOB = 8, 8


@dataclass
class RunStats:
    rounds: int = 0
    frontier_sizes: list[int] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


def initial_dist(vertices: DataFrame, source: int, partitions: int) -> DataFrame:
    """``(v, d, parent, fresh)`` for every vertex, hash-partitioned by ``v``.

    ``fresh`` marks the vertices whose ``d`` decreased in the last round: they
    are the next frontier.  (A flag rather than a round number keeps every
    round's plan -- and its generated code -- identical.)
    """
    is_source = F.col("v") == F.lit(source)
    return (
        with_source(vertices, source)
        .select(
            "v",
            F.when(is_source, F.lit(0.0)).alias("d"),
            F.lit(None).cast("bigint").alias("parent"),
            is_source.alias("fresh"),
        )
        .repartition(partitions, "v")
    )


def best_candidates(expanded: DataFrame) -> DataFrame:
    """From ``(src, dst, weight, d)`` rows: min message per destination -> ``(v, d, parent)``."""
    reached = expanded.where(F.col("d").isNotNull())
    msg = message(F.col("d"), F.col("weight"))
    return reached.groupBy(F.col("dst").alias("v")).agg(*best_message(msg, F.col("src")))


def apply_candidates(dist: DataFrame, candidates: DataFrame) -> DataFrame:
    """Strict improvements replace ``d``/``parent`` and become fresh; one co-partitioned left join."""
    cand = candidates.select("v", F.col("d").alias("c_d"), F.col("parent").alias("c_parent"))
    better = F.col("c_d").isNotNull() & (F.col("d").isNull() | (F.col("c_d") < F.col("d")))
    return dist.join(cand.hint("shuffle_hash"), "v", "left").select(
        "v",
        F.when(better, F.col("c_d")).otherwise(F.col("d")).alias("d"),
        F.when(better, F.col("c_parent")).otherwise(F.col("parent")).alias("parent"),
        better.alias("fresh"),
    )


def frontier_of(dist: DataFrame) -> DataFrame:
    return dist.where(F.col("fresh")).select("v", "d")


class DeepHops:
    """Several hops in one job, each of them one shuffle of the messages.

    The edges are dealt out by ``src`` as the distances are by ``v``, so what a
    hop has improved meets its out-edges where it lies.  Each vertex has a row
    ``own`` beside its edges, by which what earlier hops of the job improved
    is passed on: the plan of a job then grows with its hops only.  Edges and
    distances are read back from written tables, which every hop finds in the
    cache (see ``write_frontier``).
    """

    DIST = "v bigint, d double, parent bigint, fresh boolean"
    EDGES = "src bigint, dst bigint, weight double, own boolean"

    def __init__(self, adjacency: Adjacency, dist: DataFrame) -> None:
        self.spark, self.partitions = dist.sparkSession, adjacency.partitions
        ends = dist.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
        edges = adjacency.edges().select("src", "dst", "weight", F.lit(False).alias("own"))
        path, _ = write_table(edges.unionByName(ends), "deep-edges")
        self.layout = persist(self.spark.read.schema(self.EDGES).parquet(path).repartition(self.partitions, "src"))
        degrees = self.layout.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
        #: A key that has to be spread over partitions does not fit this layout.
        self.hot = not degrees.where(F.col("deg") > F.lit(adjacency.threshold + 1)).isEmpty()

    def written(self, dist: DataFrame) -> tuple[DataFrame, int]:
        """``dist`` read back from a table, cached and hash-partitioned by ``v``, and the number of its fresh vertices."""
        path, rows = write_table(dist.select("v", "d", "parent", "fresh"), "deep-dist", static=True, only=F.col("fresh"))
        return persist(self.spark.read.schema(self.DIST).parquet(path).repartition(self.partitions, "v")), rows

    def _hop(self, was: DataFrame, improved: DataFrame) -> DataFrame:
        """``improved`` (src, d, parent, fresh), all vertices that are better than ``was`` (v, was), after one more hop."""
        rows = self.layout.join(improved.hint("shuffle_hash"), "src").where("own or fresh")
        best = rows.groupBy(F.col("dst").alias("v")).agg(
            F.expr("min(case when not own then d + weight end)").alias("c_d"),
            F.expr("min_by(src, case when not own then d + weight end)").alias("c_parent"),
            F.expr("min(case when own then d end)").alias("o_d"),
            F.expr("min_by(parent, case when own then d end)").alias("o_parent"),
        )
        joined = was.join(best.hint("shuffle_hash"), "v")
        # Only a strict decrease changes the parent.
        better = "coalesce(c_d < coalesce(o_d, was), c_d is not null)"
        return joined.where(f"o_d is not null or {better}").selectExpr(
            "v as src", f"if({better}, c_d, o_d) as d", f"if({better}, c_parent, o_parent) as parent", f"{better} as fresh"
        )

    def after(self, dist: DataFrame, hops: int) -> DataFrame:
        """A written ``dist`` after ``hops`` hops from its fresh vertices."""
        was = dist.select("v", F.col("d").alias("was"))
        improved = dist.where("fresh").select(F.col("v").alias("src"), "d", "parent", "fresh")
        for _ in range(hops):
            improved = self._hop(was, improved)
        new = improved.selectExpr("src as v", "d as n_d", "parent as n_parent", "fresh as n_fresh")
        return dist.join(new.hint("shuffle_hash"), "v", "left").selectExpr(
            "v",
            "if(n_fresh is null, d, n_d) as d",
            "if(n_fresh is null, parent, n_parent) as parent",
            "coalesce(n_fresh, false) as fresh",
        )

    def run(self, dist: DataFrame, stats: RunStats) -> DataFrame:
        """``dist`` at the fixpoint."""
        dist, rows = self.written(dist)
        while rows:
            after, rows = self.written(self.after(dist, HOPS_PER_JOB))
            dist.unpersist(blocking=False)
            dist = after
            stats.frontier_sizes.append(rows)
            stats.rounds += 1
        self.layout.unpersist(blocking=False)
        return dist


def relax(
    adjacency: Adjacency,
    dist: DataFrame,
    checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL,
    stats: RunStats | None = None,
    stepwise: int = STEPWISE_ROUNDS,
) -> DataFrame:
    """Relax from the fresh vertices of ``dist`` until nothing improves.

    ``dist`` must be hash-partitioned by ``v`` with ``adjacency.partitions``
    partitions and already cut from its lineage.  Per round: one job writes
    the new frontier (and so materialises the new ``dist``), a cheap one
    counts it; every ``checkpoint_interval`` rounds ``dist`` is checkpointed
    to the shared folder.  After ``stepwise`` rounds a job takes several hops
    and counts as one round.  Returns the final ``dist`` (cached; its lineage
    reaches back at most ``checkpoint_interval`` rounds).
    """
    stats = stats if stats is not None else RunStats()
    gens = Generations()
    gens.hold(dist)
    key = adjacency.key
    frontier, rows = write_frontier(frontier_of(dist).select(F.col("v").alias(key), "d"))
    done = 0
    while rows > 0:
        if done == stepwise:
            deep = DeepHops(adjacency, dist)
            if not deep.hot:
                stats.rounds = done
                out = deep.run(dist, stats)
                gens.release()
                return out
        expanded = adjacency.expand(frontier, rows)
        nxt = apply_candidates(dist, best_candidates(expanded))
        done += 1
        nxt = cut(nxt) if done % checkpoint_interval == 0 else persist(nxt)
        dist = gens.hold(nxt)
        frontier, rows = write_frontier(frontier_of(dist).select(F.col("v").alias(key), "d"))
        stats.frontier_sizes.append(rows)
    stats.rounds = done
    # ``dist`` is cached and was materialised by the last frontier write; its
    # lineage reaches back at most ``checkpoint_interval`` rounds, through
    # checkpoints and written frontier tables only.
    gens.release_except(dist)
    return dist


def sssp_on(
    adjacency: Adjacency,
    source: int = 0,
    checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL,
    stats: RunStats | None = None,
) -> DataFrame:
    """Full SSSP over edges that are laid out -> ``(v, d, parent)`` for every vertex (and the source)."""
    dist = cut(initial_dist(vertices_from_edges(adjacency.base), source, adjacency.partitions))
    return relax(adjacency, dist, checkpoint_interval, stats).select("v", "d", "parent")


def sssp_state(
    edges: DataFrame,
    source: int = 0,
    validate: bool = True,
    partitions: int | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
    checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL,
    stats: RunStats | None = None,
    collapse: bool = True,
) -> DataFrame:
    """Full SSSP -> ``(v, d, parent)`` for every vertex (and the source).

    ``collapse``: False for edges that have no parallel ones.
    """
    n = num_partitions(edges.sparkSession, partitions)
    adjacency = Adjacency.build(prepare_edges(edges, validate, collapse), "src", "dst", n, broadcast_rows, min_hot_rows)
    out = sssp_on(adjacency, source, checkpoint_interval, stats)
    adjacency.release()
    return out


def sssp(edges: DataFrame, source: int = 0, **kwargs) -> DataFrame:
    """Shortest distance from ``source`` to every vertex -> ``(v, d)``; NULL = unreachable."""
    return sssp_state(edges, source, **kwargs).select("v", "d")


def hop_count(edges: DataFrame, source: int = 0, **kwargs) -> DataFrame:
    """Unit-weight distances (number of edges on a shortest path) -> ``(v, d)``."""
    unit = edges.select("src", "dst", F.lit(1.0).alias("weight"))
    return sssp(unit, source, **kwargs)

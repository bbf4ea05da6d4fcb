"""Distances kept current over many updates: the edge layout and the state stay, a batch adds to them.

``LiveDistances`` holds the edges in an :class:`Adjacency` and ``(v, d,
parent)`` cached and hash-partitioned by ``v``.  A batch of updates

1. is looked up in the edges (its keys are broadcast, the edges are streamed
   where they lie) and becomes a delta ``(src, dst, old_w, new_w)``;
2. patches the adjacency with a small table that hides the changed edges;
3. invalidates the parent subtrees below raised or deleted edges: a frontier
   walk down the forest, and from ``WALK_STEPS`` levels on pointer jumping,
   whose rounds grow with the logarithm of the depth;
4. relaxes from the best offers into invalidated vertices and from lighter or
   new edges.  Improved vertices are kept as an overlay of small tables beside
   the state: a round is one job that joins the candidates with the cached
   state on its own partitioning, and writes the improved rows only.

Edges are never shuffled or written by a batch, and the state is written once,
at its end.  An overlay or a frontier that outgrows ``broadcast_rows``, or is
not done after ``STEPWISE_ROUNDS`` rounds (each adds a table to the overlay),
is merged into the state, and the ordinary relaxation loop goes on from there;
after many rounds it takes several hops in a job, for which the edges are dealt
out once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import best_message, message
from ..operators.adjacency import DEFAULT_BROADCAST_ROWS, DEFAULT_MIN_HOT_ROWS, Adjacency
from ..operators.changes import latest_updates
from ..operators.graph import prepare_edges, vertices_from_edges
from ..session import num_partitions
from .lineage import cut, persist, write_frontier, write_table
from .sssp import STEPWISE_ROUNDS, RunStats, initial_dist, relax

#: Levels of the parent forest that are walked one by one before pointers are jumped.
WALK_STEPS = 6
CUT_BATCHES = 8


def read_overlay(like: DataFrame, paths: list[str]) -> DataFrame:
    """Rows (v, d, parent) of written tables; those of vertices alone have no distance.

    One scan of all paths, so the plan (and its generated code) is the same
    however many tables there are.
    """
    return like.sparkSession.read.schema("v bigint, d double, parent bigint").parquet(*paths)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def _old_weights(adjacency: Adjacency, keys: DataFrame, n: int) -> DataFrame:
    """(src, dst, old_w) of the known edges among ``n`` keys; edges are unique, so there are no more than keys."""
    old = adjacency.on_keys(keys.select("src", "dst"), n).select("src", "dst", F.col("weight").alias("old_w"))
    return F.broadcast(old) if n <= adjacency.broadcast_rows else old


def batch_changes(adjacency: Adjacency, updates: DataFrame, insert: bool) -> tuple[DataFrame, int]:
    """The edges that a batch of updates changes, ``(src, dst, old_w, new_w)``, and their number.

    ``insert``: unknown edges are new ones, else they are ignored.
    """
    latest = latest_updates(updates).select("src", "dst", F.col("weight").alias("new_w"))
    latest, n = write_frontier(latest, "updates")
    joined = latest.join(_old_weights(adjacency, latest, n), ["src", "dst"], "left" if insert else "inner")
    delta = joined.where(~F.col("old_w").eqNullSafe(F.col("new_w"))).select("src", "dst", "old_w", "new_w")
    return write_frontier(delta, "delta")


@dataclass
class Change:
    """What a batch did: changed edges, and vertices whose distance moved ``(v, d_old, d_new)``, with their numbers."""

    delta: DataFrame
    n_delta: int
    moved: DataFrame
    n_moved: int
    before: "LiveDistances"
    after: "LiveDistances"
    stats: RunStats

    def rows(self) -> DataFrame:
        """The rows (v, d, parent) that the batch changed or added.  Both states lie alike, so nothing is shuffled."""
        old = self.before.state.select("v", F.col("d").alias("old_d"), F.col("parent").alias("old_parent"), F.lit(True).alias("known"))
        joined = self.after.state.join(old.hint("shuffle_hash"), "v", "left")
        same = F.col("known") & F.col("d").eqNullSafe(F.col("old_d")) & F.col("parent").eqNullSafe(F.col("old_parent"))
        return joined.where(~F.coalesce(same, F.lit(False))).select("v", "d", "parent")

    def disturbed(self) -> DataFrame:
        """Vertices that got another message than before from some in-neighbour -> ``(v)``.

        Only out-edges of moved vertices and the changed edges can carry
        another message, so only these are looked at.
        """
        bound = self.after.adjacency.broadcast_rows
        moved = self.moved.withColumnRenamed("v", "src")
        # An edge that did not change has the same weight before and after.
        same = self.before.adjacency.expand(moved, self.n_moved)
        delta = F.broadcast(self.delta) if self.n_delta <= bound else self.delta
        same = same.join(delta.select("src", "dst"), ["src", "dst"], "left_anti")
        kept = same.select("dst", (F.col("d_old") + F.col("weight")).alias("old_msg"), (F.col("d_new") + F.col("weight")).alias("new_msg"))
        # The senders of changed edges: no more than there are changed edges.
        ends = self.delta.select("src").distinct()
        senders = self.before.state.select(F.col("v").alias("src"), F.col("d").alias("d_before"))
        senders = senders.join(F.broadcast(ends) if self.n_delta <= bound else ends, "src", "left_semi")
        own = self.delta.join(F.broadcast(senders) if self.n_delta <= bound else senders, "src", "left")
        own = own.join(F.broadcast(moved) if self.n_moved <= bound else moved, "src", "left")
        d_new = F.when(F.col("d_old").eqNullSafe(F.col("d_new")), F.col("d_before")).otherwise(F.col("d_new"))
        changed = own.select("dst", (F.col("d_before") + F.col("old_w")).alias("old_msg"), (d_new + F.col("new_w")).alias("new_msg"))
        rows = kept.unionByName(changed)
        return rows.where(~F.col("old_msg").eqNullSafe(F.col("new_msg"))).select(F.col("dst").alias("v")).distinct()


class LiveDistances:
    """Edges and ``(v, d, parent)`` that batches of updates are applied to; each batch gives a new object."""

    def __init__(self, adjacency: Adjacency, state: DataFrame, source: int, batches: int = 0) -> None:
        self.adjacency = adjacency
        self.state = state
        self.source = source
        #: Batches since the edges were laid out; the state's lineage is cut every ``CUT_BATCHES`` of them.
        self.batches = batches

    @classmethod
    def build(
        cls,
        edges: DataFrame,
        source: int = 0,
        validate: bool = True,
        partitions: int | None = None,
        broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
        min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
        state: DataFrame | None = None,
    ) -> "LiveDistances":
        """From edges, by a full run, or from a saved ``state`` (v, d, parent) of these edges."""
        n = num_partitions(edges.sparkSession, partitions)
        adjacency = Adjacency.build(prepare_edges(edges, validate=validate), "src", "dst", n, broadcast_rows, min_hot_rows)
        if state is None:
            dist = relax(adjacency, cut(initial_dist(vertices_from_edges(adjacency.base), source, n)))
            return cls(adjacency, dist.select("v", "d", "parent"), source)
        return cls(adjacency, persist(state.select("v", "d", "parent").repartition(n, "v")), source)

    def edges(self) -> DataFrame:
        return self.adjacency.edges().select("src", "dst", "weight")

    def distances(self) -> DataFrame:
        return self.state.select("v", "d")

    def update(self, updates: DataFrame) -> Change:
        """New weights (last by ``seq``) for known edges; unknown ones are ignored."""
        return self._apply(updates, insert=False)

    def upsert(self, updates: DataFrame) -> Change:
        """New weights for known edges, unknown ones are inserted."""
        return self._apply(updates, insert=True)

    def _apply(self, updates: DataFrame, insert: bool) -> Change:
        return self.change(*batch_changes(self.adjacency, updates, insert))

    def insert(self, rows: DataFrame) -> Change:
        """Insert edges; parallel ones, and those that are known, collapse to the smallest weight."""
        new, n = write_frontier(prepare_edges(rows).withColumnRenamed("weight", "new_w"), "inserts")
        joined = new.join(_old_weights(self.adjacency, new, n), ["src", "dst"], "left")
        delta = joined.where("old_w is null or new_w < old_w").select("src", "dst", "old_w", "new_w")
        return self.change(*write_frontier(delta, "delta"))

    def change(self, delta: DataFrame, n_delta: int) -> Change:
        """Apply changed edges ``(src, dst, old_w, new_w)``, one row per key; NULL = absent on that side."""
        stats = RunStats()
        if not n_delta:
            nothing = self.state.where("false").select("v", F.col("d").alias("d_old"), F.col("d").alias("d_new"))
            return Change(delta, 0, nothing, 0, self, self, stats)
        changes = delta.select("src", "dst", F.col("new_w").alias("weight"))
        adjacency = self.adjacency.patched(changes, n_delta)
        state = self._with_vertices(delta)
        gone, n_gone = self._invalid(state, delta, n_delta, stats)
        stats.extra["invalidated"] = n_gone
        after = _Relaxation(self, adjacency, state, delta, gone, n_gone, stats).run()
        moved = after.state.select("v", F.col("d").alias("d_new"))
        moved = state.select("v", F.col("d").alias("d_old")).join(moved.hint("shuffle_hash"), "v")
        moved = moved.where(~F.col("d_old").eqNullSafe(F.col("d_new"))).select("v", "d_old", "d_new")
        moved, n_moved = write_frontier(moved, "moved", static=True)
        return Change(delta, n_delta, moved, n_moved, self, after, stats)

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= self.adjacency.broadcast_rows else df

    def _with_vertices(self, delta: DataFrame) -> DataFrame:
        """The state with a row for each end of an inserted edge."""
        ends = vertices_from_edges(delta.where(F.col("old_w").isNull() & F.col("new_w").isNotNull()))
        ends, n = write_frontier(ends, "ends")
        if not n:
            return self.state
        known = self.state.join(self._small(ends, n), "v", "left_semi").select("v")
        fresh, n_fresh = write_frontier(ends.join(known, "v", "left_anti"), "fresh")
        if not n_fresh:
            return self.state
        row = fresh.select("v", F.lit(None).cast("double").alias("d"), F.lit(None).cast("bigint").alias("parent"))
        return persist(self.state.unionByName(row).repartition(self.adjacency.partitions, "v"))

    def _invalid(self, state: DataFrame, delta: DataFrame, n_delta: int, stats: RunStats) -> tuple[list[str], int]:
        """The vertices below raised or deleted parent edges: paths of tables ``(v)``, and their number."""
        raised = delta.where(F.col("old_w").isNotNull() & (F.col("new_w").isNull() | (F.col("new_w") > F.col("old_w"))))
        hit = raised.select(F.col("src").alias("parent"), F.col("dst").alias("v"))
        tree = state.where(F.col("parent").isNotNull()).select("v", "parent")
        path, n = write_table(tree.join(self._small(hit, n_delta), ["v", "parent"], "left_semi").select("v"), "invalid")
        if not n:
            return [], 0
        paths, total = [path], n
        for step in range(WALK_STEPS):
            above = self._small(read_overlay(state, [path]).select(F.col("v").alias("parent")), n)
            kids = tree.join(above, "parent", "left_semi").select("v")
            # A hit vertex may lie below another one.
            kids = kids.join(self._small(read_overlay(state, paths).select("v"), total), "v", "left_anti")
            path, n = write_table(kids, "invalid")
            stats.extra["walked"] = step + 1
            if not n:
                return paths, total
            paths.append(path)
            total += n
        return self._jump(tree, read_overlay(state, paths).select("v"), total, stats)

    def _jump(self, tree: DataFrame, roots: DataFrame, n_roots: int, stats: RunStats) -> tuple[list[str], int]:
        """Everything below ``roots`` in the forest, by doubling each vertex's pointer to an ancestor."""
        mark = self._small(roots.select("v", F.lit(True).alias("gone")), n_roots)
        open_ = tree.join(mark, "v", "left").select("v", F.col("parent").alias("up"), F.coalesce("gone", F.lit(False)).alias("gone"))
        # A pointer to a gone vertex has done its work; so has one to the source.
        nodes, n = write_frontier(open_, "pointers")
        below, rounds = [roots], 0
        while True:
            target = nodes.select(F.col("v").alias("up"), F.col("up").alias("further"), F.col("gone").alias("hit"))
            step = nodes.where("not gone and up is not null").join(target, "up", "left")
            hit = F.coalesce(F.col("hit"), F.lit(False))
            step = step.select("v", F.when(~hit, F.col("further")).alias("up"), hit.alias("gone"))
            moved, n_moved = write_frontier(step, "pointers")
            rounds += 1
            below.append(moved.where("gone").select("v"))
            still = moved.where("not gone and up is not null").count()
            if not still:
                break
            settled = nodes.where("gone or up is null")
            nodes, _ = write_frontier(settled.unionByName(moved), "pointers")
        stats.extra["jumps"] = rounds
        path, n = write_table(_union(below), "invalid")
        return [path], n

    def retire(self, after: "LiveDistances") -> None:
        """Release what ``after``, which has been computed, does not share with this object."""
        if after.state is not self.state:
            self.state.unpersist(blocking=False)
        if after.adjacency.base is not self.adjacency.base:
            self.adjacency.release()

    def release(self) -> None:
        self.adjacency.release()
        self.state.unpersist(blocking=False)


class _Relaxation:
    """Phase 2 of a batch: improved rows as an overlay beside the state."""

    def __init__(self, live: LiveDistances, adjacency: Adjacency, state: DataFrame, delta: DataFrame, gone: list[str], n_gone: int, stats: RunStats) -> None:
        self.live, self.adjacency, self.state = live, adjacency, state
        self.delta, self.gone, self.n_gone = delta, gone, n_gone
        self.bound = adjacency.broadcast_rows
        self.stats = stats
        self.improved: list[str] = []
        self.n_improved = 0

    def _overlay(self) -> DataFrame | None:
        """(v, o_d, o_parent) of all vertices that differ from the state: invalidated ones without a distance, improved ones with their best."""
        if not self.gone and not self.improved:
            return None
        rows = read_overlay(self.state, [*self.gone, *self.improved])
        rows = rows.groupBy("v").agg(F.min("d").alias("o_d"), F.min_by("parent", "d").alias("o_parent"))
        return rows.withColumn("over", F.lit(True))

    def _now(self) -> DataFrame:
        """The state with the overlay, on the state's partitioning."""
        over = self._overlay()
        if over is None:
            return self.state
        small = F.broadcast(over) if self.n_improved + self.n_gone <= self.bound else over.hint("shuffle_hash")
        pick = lambda a, b: F.when(F.col("over"), F.col(a)).otherwise(F.col(b))
        return self.state.join(small, "v", "left").select("v", pick("o_d", "d").alias("d"), pick("o_parent", "parent").alias("parent"))

    def _better(self, offers: DataFrame) -> tuple[DataFrame, int]:
        """From offers (src, dst, weight, d): the rows (v, d, parent) that improve a vertex."""
        best = offers.groupBy(F.col("dst").alias("v")).agg(*best_message(message(F.col("d"), F.col("weight")), F.col("src")))
        best = best.select("v", F.col("d").alias("c_d"), F.col("parent").alias("c_parent"))
        # Only rows that an offer reaches are looked at: the state is streamed past the offers.
        joined = self._now().join(best.hint("shuffle_hash"), "v")
        rows = joined.where(F.col("d").isNull() | (F.col("c_d") < F.col("d")))
        rows = rows.where(F.col("v") != F.lit(self.live.source))
        path, n = write_table(rows.select("v", F.col("c_d").alias("d"), F.col("c_parent").alias("parent")), "improved", static=True)
        if n:
            self.improved.append(path)
            self.n_improved += n
        return read_overlay(self.state, [path]), n

    def _seeds(self) -> DataFrame:
        """Offers into invalidated vertices, and those of lighter or new edges."""
        lighter = F.col("new_w").isNotNull() & (F.col("old_w").isNull() | (F.col("new_w") < F.col("old_w")))
        rows = self.delta.where(lighter).select("src", "dst", F.col("new_w").alias("weight"))
        if self.n_gone:
            ends = read_overlay(self.state, self.gone).select(F.col("v").alias("dst"))
            pulled = self.adjacency.into(ends, self.n_gone)
            rows = rows.unionByName(pulled.select("src", "dst", "weight"))
        rows, n = write_frontier(rows, "offers")
        senders = self._now().where(F.col("d").isNotNull()).select(F.col("v").alias("src"), "d")
        return senders.join(F.broadcast(rows) if n <= self.bound else rows.hint("shuffle_hash"), "src")

    def run(self) -> LiveDistances:
        front, n = self._better(self._seeds())
        rounds = 0
        while n:
            if max(n, self.n_improved + self.n_gone) > self.bound:
                return self._whole(front, STEPWISE_ROUNDS)
            if rounds >= STEPWISE_ROUNDS:
                return self._whole(front, 0)
            rounds += 1
            self.stats.frontier_sizes.append(n)
            front, n = self._better(self.adjacency.expand(front.select(F.col("v").alias("src"), "d"), n))
        self.stats.rounds = rounds
        batches = self.live.batches + 1
        state = cut(self._now()) if batches % CUT_BATCHES == 0 else persist(self._now())
        return LiveDistances(self.adjacency, state, self.live.source, batches)

    def _whole(self, front: DataFrame, stepwise: int) -> LiveDistances:
        """Merge the overlay into the state and go on with the loop over whole states."""
        mark = front.select("v", F.lit(True).alias("fresh"))
        rows = self._now().join(mark, "v", "left").select("v", "d", "parent", F.coalesce("fresh", F.lit(False)).alias("fresh"))
        dist = relax(self.adjacency, cut(rows.repartition(self.adjacency.partitions, "v")), stats=self.stats, stepwise=stepwise)
        return LiveDistances(self.adjacency, dist.select("v", "d", "parent"), self.live.source, self.live.batches + 1)

"""Edges laid out once for many frontier expansions (the join at the heart of every loop).

Each round of a message-passing loop joins a frontier ``(key, payload)`` to
the adjacency rows of its keys.  The rows are materialised once (checkpointed,
so no round recomputes their lineage) and then:

* frontier rows <= ``broadcast_rows`` (an exact count the loop already has):
  broadcast hash join; the edge partitions are streamed where they are, so
  the skew of the key does not matter and nothing of the edges is shuffled;
* larger frontiers: a shuffled hash join on ``(key, salt)`` against a layout
  hash-partitioned by ``(key, salt)`` that is built (once) on first need, so
  each round shuffles only the frontier.

Skew: a key whose degree exceeds ``rows / partitions`` (a "hot" key, e.g. a
hub holding a third of all edges) is spread over ``ceil(degree / threshold)``
salt buckets by a hash of the row's other end, and its frontier row is
replicated once per bucket.  There are fewer hot keys than partitions, so the
hot-key table that is broadcast has a proven size bound.

On disk: with ``stored`` a large table is written once, dealt out into buckets
by ``(key, salt)``, and is neither cached nor dealt out again; frontiers of
both sizes are joined to it where it lies.

Changes: ``patched`` gives the same layout with some edges changed.  The
changed edges are a small table beside the base that hides the base's rows of
the same key, so a batch of updates neither shuffles nor writes the edges.
Once that table outgrows its bound, the edges are laid out anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, delete_table, on_buckets, persist, write_buckets, write_frontier, write_table
from ..session import num_partitions as _num_partitions

# Frontiers up to this many rows are broadcast (a (BIGINT, DOUBLE) row is ~16 bytes).
DEFAULT_BROADCAST_ROWS = 1_000_000
# Keys with fewer rows than this are never salted, whatever the partition count.
DEFAULT_MIN_HOT_ROWS = 100_000
# Rows of a bucket, and rows up to which a stored table is cached instead (some 100 MB, whatever the partitions).
BUCKET_ROWS = 1_000_000
CACHED_ROWS = 5_000_000
# Cells by whose row counts hot keys are looked for.
HOT_CELLS = 16_384


def bucket_count(rows: int, partitions: int) -> int:
    return max(partitions, -(-rows // BUCKET_ROWS))


def hot_keys(table: DataFrame, key: str, threshold: int) -> tuple[DataFrame, int]:
    """``(key, n_salt)`` of the keys with more than ``threshold`` rows, and their number.

    Only rows of cells (by a hash of the key) with that many rows are grouped
    by their key, so what is shuffled does not grow with the keys.
    """
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(HOT_CELLS)).cast("int")
    counts = table.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells, n = write_frontier(counts.where(F.col("n") > F.lit(threshold)).select("cell"), "hot-cells")
    few = table.select(key, cell.alias("cell")).join(F.broadcast(cells), "cell", "left_semi") if n else table.limit(0)
    hot = few.groupBy(key).agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > F.lit(threshold))
    return write_frontier(hot.select(key, F.ceil(F.col("deg") / F.lit(threshold)).cast("int").alias("n_salt")), "hot-keys")


def with_slot(rows: DataFrame, key: str, spread: str, hot: tuple[DataFrame, int], deal: int | None = None) -> DataFrame:
    """``rows`` with the ``slot`` that deals them out: the key, for hot keys one of its salts by ``spread``.

    ``deal``: into so many partitions; the slot itself is not shuffled.
    """
    keys, n = hot
    slot = F.col(key)
    if n:
        rows = rows.join(F.broadcast(keys), key, "left")
        salt = F.pmod(F.xxhash64(F.col(spread)), F.col("n_salt")).cast("int")
        slot = F.when(F.col("n_salt").isNull(), slot).otherwise(F.xxhash64(slot, salt))
    if deal:
        rows = rows.repartition(deal, slot)
    return rows.withColumn("slot", slot).drop("n_salt")


class Adjacency:
    def __init__(
        self,
        base: DataFrame,
        key: str,
        spread: str,
        rows: int,
        partitions: int,
        broadcast_rows: int,
        min_hot_rows: int,
    ) -> None:
        self.base = base
        self.key = key
        self.spread = spread
        self.rows = rows
        self.partitions = partitions
        self.broadcast_rows = int(broadcast_rows)
        self.min_hot_rows = int(min_hot_rows)
        self._layout: DataFrame | None = None
        self._hot: DataFrame | None = None
        #: Changed edges beside the base (NULL weight: gone), one row per key, and their number.
        self.changes: DataFrame | None = None
        self.n_changes = 0
        self._reverse: Adjacency | None = None
        #: The base in buckets with its ``slot``, where it is written, and its hot keys.
        self.path: str | None = None
        self._buckets: DataFrame | None = None
        self._hot_slots: tuple[DataFrame, int] | None = None

    @classmethod
    def build(
        cls,
        table: DataFrame,
        key: str = "src",
        spread: str = "dst",
        partitions: int | None = None,
        broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
        min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
        stored: bool = False,
    ) -> "Adjacency":
        n = _num_partitions(table.sparkSession, partitions)
        if stored:
            return cls._build_stored(table, key, spread, n, broadcast_rows, min_hot_rows)
        # Materialised once as a parquet table in the shared folder (columnar,
        # durable, counted on the write); rounds then stream it from cache.
        written, rows = write_frontier(table, "adjacency")
        return cls(persist(written), key, spread, rows, n, broadcast_rows, min_hot_rows)

    @classmethod
    def _build_stored(cls, table: DataFrame, key: str, spread: str, n: int, broadcast_rows: int, min_hot_rows: int) -> "Adjacency":
        spark = table.sparkSession
        with on_buckets(spark):
            # In order, the edges take a third of the space, and so do those that are dealt out.
            path, rows = write_table(table.sortWithinPartitions(key, spread), "adjacency")
            written = spark.read.schema(table.schema).parquet(path)
            if rows <= CACHED_ROWS:
                return cls(persist(written), key, spread, rows, n, broadcast_rows, min_hot_rows)
            out = cls(written, key, spread, rows, bucket_count(rows, n), broadcast_rows, min_hot_rows)
            out._hot_slots = hot_keys(written, key, out.threshold)
            dealt = with_slot(written, key, spread, out._hot_slots, out.partitions)
            out._buckets, out.path, *_ = write_buckets(dealt, "adjacency", out.partitions, ["slot"], ["slot", key, spread])
            out.base = out._buckets.drop("slot")
            delete_table(spark, path)
        return out

    @property
    def threshold(self) -> int:
        return max(int(math.ceil(self.rows / self.partitions)) if self.rows else 1, self.min_hot_rows, 1)

    def _ensure_layout(self) -> None:
        if self._layout is not None:
            return
        thr = self.threshold
        hot = (
            self.base.groupBy(self.key)
            .agg(F.count(F.lit(1)).alias("deg"))
            .where(F.col("deg") > F.lit(thr))
            .select(self.key, F.ceil(F.col("deg") / F.lit(thr)).cast("int").alias("n_salt"))
        )
        self._hot = cut(hot)  # fewer rows than partitions
        salt = F.when(F.col("n_salt").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.col(self.spread)), F.col("n_salt")).cast("int")
        )
        salted = self.base.join(F.broadcast(self._hot), self.key, "left").withColumn("salt", salt).drop("n_salt")
        # Lost blocks are dealt out again from the base, a written table.
        self._layout = persist(salted.repartition(self.partitions, self.key, "salt"))

    def _expand_base(self, frontier: DataFrame, frontier_rows: int) -> DataFrame:
        if frontier_rows <= self.broadcast_rows:
            return self.base.join(F.broadcast(frontier), self.key, "inner")
        if self._buckets is not None:
            keys, n_hot = self._hot_slots
            slotted = frontier.withColumn("slot", F.col(self.key))
            if n_hot:
                salts = F.sequence(F.lit(0), F.col("n_salt") - F.lit(1))
                slots = F.transform(salts, lambda salt: F.xxhash64(F.col(self.key), salt))
                slots = F.when(F.col("n_salt").isNull(), F.array(F.col(self.key))).otherwise(slots)
                slotted = frontier.join(F.broadcast(keys), self.key, "left").withColumn("slot", F.explode(slots)).drop("n_salt")
            return self._buckets.join(slotted.hint("shuffle_hash"), ["slot", self.key], "inner").drop("slot")
        self._ensure_layout()
        replicas = F.sequence(F.lit(0), F.coalesce(F.col("n_salt"), F.lit(1)) - F.lit(1))
        salted = (
            frontier.join(F.broadcast(self._hot), self.key, "left")
            .withColumn("salt", F.explode(replicas))
            .drop("n_salt")
        )
        return self._layout.join(salted.hint("shuffle_hash"), [self.key, "salt"], "inner").drop("salt")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of the base without those that a change hides."""
        if self.changes is None:
            return rows
        return rows.join(F.broadcast(self.changes.select(self.key, self.spread)), [self.key, self.spread], "left_anti")

    def expand(self, frontier: DataFrame, frontier_rows: int) -> DataFrame:
        """Join ``frontier`` (must carry column ``self.key``) to its adjacency rows."""
        rows = self._current(self._expand_base(frontier, frontier_rows))
        if self.changes is None:
            return rows
        small = F.broadcast(frontier) if frontier_rows <= self.broadcast_rows else frontier
        return rows.unionByName(self.changes.where(F.col("weight").isNotNull()).join(small, self.key, "inner"))

    def edges(self) -> DataFrame:
        """All edges with the changes."""
        rows = self._current(self.base)
        return rows if self.changes is None else rows.unionByName(self.changes.where(F.col("weight").isNotNull()))

    def on_keys(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """The edges whose (key, spread) is in ``keys``; the base is streamed where it lies if the keys are few."""
        small = F.broadcast(keys) if n_keys <= self.broadcast_rows else keys
        own = [self.key, self.spread]
        rows = self._current(self.base.join(small, own, "left_semi"))
        if self.changes is None:
            return rows
        return rows.unionByName(self.changes.where(F.col("weight").isNotNull()).join(small, own, "left_semi"))

    def into(self, ends: DataFrame, n_ends: int) -> DataFrame:
        """The edges whose other end is in ``ends`` (one column, named ``self.spread``).

        Few ends are broadcast to the base; for many there is a layout keyed by
        the other end, salted like this one, built on first need.
        """
        if n_ends <= self.broadcast_rows:
            small = F.broadcast(ends)
            rows = self._current(self.base.join(small, self.spread, "left_semi"))
            return rows if self.changes is None else rows.unionByName(self.changes.where(F.col("weight").isNotNull()).join(small, self.spread, "left_semi"))
        return self.reverse().expand(ends, n_ends)

    def reverse(self) -> "Adjacency":
        """The same edges keyed by their other end: the layout for steps that pull from in-neighbours."""
        if self._reverse is None:
            out = Adjacency(self.base, self.spread, self.key, self.rows, self.partitions, self.broadcast_rows, self.min_hot_rows)
            out.changes, out.n_changes = self.changes, self.n_changes
            self._reverse = out
        return self._reverse

    def patched(self, changes: DataFrame, n_changes: int) -> "Adjacency":
        """This layout with some edges changed: ``changes`` (src, dst, weight), one row per key, NULL weight = gone.

        The base and its salted layout are shared with this object.  Changes
        beyond ``broadcast_rows`` rows make a new base.
        """
        if self.changes is not None:
            older = self.changes.join(changes.select(self.key, self.spread), [self.key, self.spread], "left_anti")
            changes, n_changes = write_frontier(older.unionByName(changes.select(*older.columns)), "edge-changes")
        out = Adjacency(self.base, self.key, self.spread, self.rows, self.partitions, self.broadcast_rows, self.min_hot_rows)
        out.changes, out.n_changes = changes, n_changes
        if n_changes > self.broadcast_rows:
            table = self.base.join(changes.select(self.key, self.spread), [self.key, self.spread], "left_anti")
            table = table.unionByName(changes.where(F.col("weight").isNotNull()).select(*table.columns))
            return Adjacency.build(table, self.key, self.spread, self.partitions, self.broadcast_rows, self.min_hot_rows)
        out._layout, out._hot = self._layout, self._hot
        out._buckets, out._hot_slots = self._buckets, self._hot_slots
        if self._reverse is not None:
            back = Adjacency(self.base, self.spread, self.key, self.rows, self.partitions, self.broadcast_rows, self.min_hot_rows)
            back._layout, back._hot, back.changes, back.n_changes = self._reverse._layout, self._reverse._hot, changes, n_changes
            out._reverse = back
        return out

    def release(self) -> None:
        for df in (self.base, self._layout, self._hot, *((self._reverse._layout, self._reverse._hot) if self._reverse else ())):
            if df is not None:
                df.unpersist(blocking=False)

"""Graphs derived from the relational tables (the fixture graphs of the tests).

* ``g_tree``: region -> nation -> customer -> order hierarchy under root 0.
* ``g_ps``: part <-> supplier graph from lineitem (cyclic, through the root).
* ``g_ev``: user-to-user transitions of consecutive events within a day; the
  events after 90 % of the largest event id become weight updates
  (``update_stream``) and new edges.

Everything is expressed with DataFrame operators, so each graph grows with
its tables and is computed by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.lineage import persist
from ..session import num_partitions
from .tables import Tables

# Fixed id offsets of the hierarchy graph: regions 1.., nations 10..,
# customers 100000.., orders 10000000..; weights are key mod 7 / 11 / 13 plus 1.
TREE_NATION_OFFSET = 10
TREE_CUSTOMER_OFFSET = 100000
TREE_ORDER_OFFSET = 10000000
# Updates are the transition events above this share of the largest event id.
UPDATE_CUT_NUM, UPDATE_CUT_DEN = 9, 10
# Events of one range of the event graph.
RANGE_ROWS = 500_000
# Line items that one task collapses into edges.
PAIR_ROWS = 1_000_000


def _e(src, dst, w) -> list:
    return [src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), w.cast("double").alias("weight")]


def g_tree(t: Tables) -> DataFrame:
    c = F.col
    region = t.region.select(*_e(F.lit(0), c("r_regionkey") + 1, c("r_regionkey") + 1))
    nation = t.nation.select(
        *_e(c("n_regionkey") + 1, c("n_nationkey") + TREE_NATION_OFFSET, c("n_nationkey") % 7 + 1)
    )
    customer = t.customer.select(
        *_e(c("c_nationkey") + TREE_NATION_OFFSET, c("c_custkey") + TREE_CUSTOMER_OFFSET, c("c_custkey") % 11 + 1)
    )
    orders = t.orders.select(
        *_e(c("o_custkey") + TREE_CUSTOMER_OFFSET, c("o_orderkey") + TREE_ORDER_OFFSET, c("o_orderkey") % 13 + 1)
    )
    return region.unionByName(nation).unionByName(customer).unionByName(orders)


def g_ps(t: Tables) -> DataFrame:
    """Each (part, supplier) pair is collapsed once, and then gives its edge in both directions.

    An edge from a part has an odd source, one from a supplier an even one, so
    no two rows have the same key.  Beyond ``PAIR_ROWS`` rows per session
    partition the pairs are dealt into more partitions, so that no task's hash
    table grows with the input.
    """
    c = F.col
    li = t.lineitem.select("l_partkey", "l_suppkey", c("l_quantity").cast("double").alias("weight"))
    tasks = -(-t.lineitem.count() // PAIR_ROWS)
    if tasks > num_partitions(li.sparkSession):
        li = li.repartition(tasks, "l_partkey", "l_suppkey")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.min("weight").alias("weight"))
    part, supplier = c("l_partkey") * 2 + 1, c("l_suppkey") * 2
    ends = lambda src, dst: F.struct(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"))
    there = F.array(ends(part, supplier))
    # Without either key both directions are the same edge.
    both = F.when(part.isNull() & supplier.isNull(), there).otherwise(F.array(ends(part, supplier), ends(supplier, part)))
    return pairs.select(F.explode(both).alias("e"), "weight").select("e.src", "e.dst", "weight")


def range_count(events: DataFrame) -> int:
    """Ranges for ``next_in_time``: as many as the session shuffles into, more where a range would exceed ``RANGE_ROWS``."""
    return max(num_partitions(events.sparkSession), -(-events.count() // RANGE_ROWS))


def next_in_time(events: DataFrame, partitions: int) -> DataFrame:
    """Each event with the user of the next event of the same day (by ``ts, event_id``).

    A per-day window would put a whole day (or any hot day) into one task.
    Instead the events are range-partitioned on ``(ts, event_id)`` -- a unique
    key, so the sampled bounds split even a burst evenly -- the successor is
    taken inside each range, and the last row of each range is stitched to the
    first row of the next non-empty range through a table with one row per
    range (bounded by the partition count).
    """
    c = F.col
    ev = events.select(
        "event_id", "ts", "user_id", "value", F.to_date("ts").alias("day")
    ).repartitionByRange(partitions, "ts", "event_id")
    ev = ev.withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("ts", "event_id")
    ranked = ev.select(
        "*",
        F.lead("user_id").over(w).alias("next_user"),
        F.lead("day").over(w).alias("next_day"),
        F.row_number().over(w).alias("pos"),
    )
    # Persisting pins one evaluation of the range bounds and partition ids.
    ranked = persist(ranked)
    firsts = ranked.where(c("pos") == 1).select("part", c("user_id").alias("f_user"), c("day").alias("f_day"))
    follow = Window.orderBy("part")  # one row per range: bounded by the partition count
    heads = firsts.select(
        c("part"),
        F.lead("f_user").over(follow).alias("h_user"),
        F.lead("f_day").over(follow).alias("h_day"),
    )
    stitched = ranked.join(F.broadcast(heads), "part", "left").select(
        "event_id",
        "ts",
        "user_id",
        "value",
        "day",
        F.when(c("next_user").isNotNull(), c("next_user")).otherwise(c("h_user")).alias("n_user"),
        F.when(c("next_user").isNotNull(), c("next_day")).otherwise(c("h_day")).alias("n_day"),
    )
    return stitched.select(
        "event_id", "ts", "user_id", "value",
        F.when(c("n_day") == c("day"), c("n_user")).alias("next_user"),
    )


def transitions(t: Tables, partitions: int | None = None) -> DataFrame:
    """``(event_id, src, dst, weight)`` for consecutive events of different users within a day."""
    c = F.col
    nx = next_in_time(t.events, partitions or range_count(t.events))
    return nx.where(c("next_user").isNotNull() & (c("user_id") != c("next_user"))).select(
        "event_id",
        c("user_id").cast("bigint").alias("src"),
        c("next_user").cast("bigint").alias("dst"),
        (F.floor(c("value")) + 1).cast("double").alias("weight"),
    )


def update_cut(t: Tables):
    """Scalar subquery: events with an id above this are updates."""
    return t.events.select(F.expr(f"max(event_id) * {UPDATE_CUT_NUM} div {UPDATE_CUT_DEN}").alias("cut")).scalar()


def g_ev_parts(t: Tables, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(base transitions, update transitions as ``(src, dst, weight, seq)``)."""
    tr = transitions(t, partitions)
    cut = update_cut(t)
    base = tr.where(F.col("event_id") <= cut).select("src", "dst", "weight")
    upd = tr.where(F.col("event_id") > cut).select(
        "src", "dst", "weight", F.col("event_id").alias("seq")
    )
    return base, upd


def g_ev(t: Tables, partitions: int | None = None) -> DataFrame:
    base, _ = g_ev_parts(t, partitions)
    return base.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def g_transitions(t: Tables, partitions: int | None = None) -> DataFrame:
    """The graph of all transitions, those of the update stream included."""
    return transitions(t, partitions).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def update_stream(t: Tables, partitions: int | None = None) -> DataFrame:
    """Raw weight updates in arrival order: ``(src, dst, weight, seq)``."""
    _, upd = g_ev_parts(t, partitions)
    return upd

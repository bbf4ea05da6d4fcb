"""Distances kept over batches: exact, without shuffling the edges, whatever path a batch takes."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from deltapath.operators.numbering import numbered
from deltapath.plans import incremental as I
from deltapath.plans.live import WALK_STEPS, LiveDistances
from deltapath.plans.sssp import RunStats
from test_incremental_property import dijkstra, mixed_batch, random_graph

DELTA = "src bigint, dst bigint, old_w double, new_w double"


def delta_of(old, new):
    o, n = ({(a, b): w for a, b, w in rows} for rows in (old, new))
    return [(*k, o.get(k), n.get(k)) for k in sorted(set(o) | set(n)) if o.get(k) != n.get(k)]


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(1, 1000), (2, 1000), (3, 3)])
def test_batches_equal_full_recompute(spark, edges, seed, broadcast_rows):
    # With few rows to broadcast, changes make a new base and the overlay is merged into the state.
    rng = random.Random(seed)
    old = random_graph(rng, 25, 70)
    live = LiveDistances.build(edges(old), 0, broadcast_rows=broadcast_rows, min_hot_rows=5)
    for _ in range(2):
        new = mixed_batch(rng, old, 25, 12)
        delta = delta_of(old, new)
        change = live.change(spark.createDataFrame(delta, DELTA), len(delta))
        want = dijkstra(new) | {}
        before, after = as_dict(live.distances()), as_dict(change.after.distances())
        assert after == {**dict.fromkeys(before), **want}
        assert sorted(map(tuple, change.after.edges().collect())) == sorted(new)
        assert {r.v: (r.d_old, r.d_new) for r in change.moved.collect()} == {v: (before.get(v), d) for v, d in after.items() if before.get(v) != d}
        memo = I.changed_memo(edges(old), live.distances(), edges(new), change.after.distances())
        assert {r.v for r in change.disturbed().collect()} == {r["dst"] for r in memo.collect()}
        state = {r.v: (r.d, r.parent) for r in live.state.collect()}
        changed = {r.v: (r.d, r.parent) for r in change.rows().collect()}
        assert {**state, **changed} == {r.v: (r.d, r.parent) for r in change.after.state.collect()}
        old, live = new, change.after


def test_update_ignores_unknown_edges_and_upsert_and_insert_add_them(edges, updates):
    live = LiveDistances.build(edges([(0, 1, 5), (1, 2, 1)]))
    batch = updates([(0, 1, 9, 1), (0, 1, 2, 2), (2, 3, 1, 1)])
    assert as_dict(live.update(batch).after.distances()) == {0: 0.0, 1: 2.0, 2: 3.0}
    assert as_dict(live.upsert(batch).after.distances()) == {0: 0.0, 1: 2.0, 2: 3.0, 3: 4.0}
    added = edges([(0, 1, 7), (0, 2, 4), (0, 2, 8), (5, 6, 1)])
    after = live.insert(added).after
    assert as_dict(after.distances()) == {0: 0.0, 1: 5.0, 2: 4.0, 5: None, 6: None}
    assert sorted(map(tuple, after.edges().collect())) == [(0, 1, 5.0), (0, 2, 4.0), (1, 2, 1.0), (5, 6, 1.0)]


def test_nothing_to_do(edges, updates):
    live = LiveDistances.build(edges([(0, 1, 5)]))
    change = live.upsert(updates([(0, 1, 5, 1)]))
    assert change.after is live and change.n_moved == 0 and change.disturbed().count() == 0


def test_invalidation_of_a_long_chain_takes_logarithmic_rounds(spark):
    n = 4096
    chain = spark.range(n).select(F.col("id").alias("v"), F.col("id").cast("double").alias("d"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    live = LiveDistances.build(spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")), state=chain)
    stats = RunStats()
    delta = spark.createDataFrame([(9, 10, 1.0, 5.0)], DELTA)
    paths, rows = live._invalid(live.state, delta, 1, stats)
    assert rows == n - 10 and {r.v for r in spark.read.parquet(*paths).collect()} == set(range(10, n))
    assert stats.extra["walked"] == WALK_STEPS and stats.extra["jumps"] <= 14


def exchanges_below(plan: str) -> int:
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_a_batch_neither_shuffles_nor_writes_the_edges(spark, edges):
    rows = [(a, b, 1.0 + (a * b) % 7) for a in range(40) for b in range(40) if a != b]
    live = LiveDistances.build(edges(rows))
    change = live.change(spark.createDataFrame([(0, 5, 1.0, 3.0), (0, 77, None, 1.0)], DELTA), 2)
    after = change.after.adjacency
    assert after.base is live.adjacency.base and after.n_changes == 2
    frontier = spark.createDataFrame([(5, 0.0)], "src bigint, d double")
    for df in (after.expand(frontier, 1), after.edges(), after.on_keys(change.delta.select("src", "dst"), 2), after.into(spark.createDataFrame([(5,)], "dst bigint"), 1)):
        assert exchanges_below(df._jdf.queryExecution().executedPlan().toString()) == 0
    assert after.into(spark.createDataFrame([(5,)], "dst bigint"), 1).where("src = 0").first().weight == 3.0


def test_pull_from_a_hub_through_the_reverse_layout(spark):
    # Vertex 1 has a third of all edges as in-edges; pulled through the salted layout keyed by the other end.
    rows = [(10 + i, 1, 1.0 + i % 3) for i in range(900)] + [(10 + i, 2000 + i, 1.0) for i in range(900)] + [(0, 10 + i, 1.0) for i in range(900)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    live = LiveDistances.build(e, broadcast_rows=0, min_hot_rows=50)
    got = live.adjacency.into(spark.createDataFrame([(1,), (2005,)], "dst bigint"), 2)
    assert got.count() == 901
    assert [r["dst"] for r in live.adjacency.reverse()._hot.collect()] == [1]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("number_text")).repartition(5)
    got = {r.k: r.number for r in numbered(rows, "k").collect()}
    assert got == {k: k for k in range(1000)}

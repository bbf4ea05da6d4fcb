"""Runs with remembered messages on disk: rounds with many offers, hubs in several buckets, what a run leaves behind."""

import os
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from conftest import as_dict
from deltapath.operators import adjacency
from deltapath.operators import graph as G
from deltapath.operators.adjacency import Adjacency
from deltapath.operators.messages import memo_table
from deltapath.plans import memo
from deltapath.plans.lineage import on_buckets, static_plan
from deltapath.plans.memo import pregel_memo, sssp_memo
from deltapath.session import checkpoint_dir
from test_incremental_property import dijkstra, random_graph
from test_memo import initial, messages


def hub_rows():
    rows = {(a, b): w for a, b, w in random_graph(random.Random(7), 40, 120, zero_share=0.0)}
    rows |= {(1, v): 3.0 + v % 4 for v in range(2, 60)} | {(v, 1): 1.0 + v % 5 for v in range(0, 60) if v != 1}
    return [(a, b, w) for (a, b), w in rows.items()]


def small_buckets(monkeypatch):
    monkeypatch.setattr(adjacency, "BUCKET_ROWS", 20)
    monkeypatch.setattr(adjacency, "CACHED_ROWS", 20)


def test_rounds_with_many_offers_and_hubs(edges, monkeypatch):
    small_buckets(monkeypatch)
    rows = hub_rows()
    e = edges(rows)
    # Receivers, then senders of more than 10 edges are spread out.
    layout = Adjacency.build(G.prepare_edges(e), "src", "dst", 4, 10, 10, stored=True)
    assert layout._buckets is not None and layout._hot_slots[1] and layout.partitions > 4
    assert sorted(map(tuple, layout.base.select("src", "dst", "weight").collect())) == sorted((a, b, float(w)) for a, b, w in rows)
    run = sssp_memo(layout, initial(e), partitions=4, broadcast_rows=10, min_hot_rows=10)
    assert run.memory.hot[1] and run.memory.base is not None
    assert as_dict(run.state) == dijkstra(rows)
    assert messages(run.memory.rows()) == messages(memo_table(e, run.state))

    # What a run returned stays readable while later runs write its memory anew.
    returned = run.memory.rows()
    before = messages(returned)
    weights = {(a, b): w for a, b, w in rows}
    for k in [(1, 5), (9, 1), (0, 1)]:
        weights[k] = 9.0
    changed = [(a, b, w) for (a, b), w in weights.items()]
    new = edges(changed)
    warm = sssp_memo(new, G.reset_flags(run.state.drop("disturbed")), memory=run.memory, partitions=4, broadcast_rows=10, min_hot_rows=10)
    assert as_dict(warm.state) == dijkstra(changed)
    assert messages(warm.memory.rows()) == messages(memo_table(new, warm.state))
    assert messages(returned) == before


def test_large_tables_are_not_cached_in_many_partitions(edges, monkeypatch):
    monkeypatch.setattr(adjacency, "CACHED_ROWS", 50)
    e = G.prepare_edges(edges(hub_rows()))
    assert Adjacency.build(e, "src", "dst", 40, 0, 10, stored=True)._buckets is not None
    few = Adjacency.build(e.limit(50), "src", "dst", 40, 0, 10, stored=True)
    assert few._buckets is None and few.base.storageLevel.useMemory


def test_only_offers_are_shuffled(edges, monkeypatch):
    small_buckets(monkeypatch)
    e = edges(hub_rows())
    layout = Adjacency.build(G.prepare_edges(e), "src", "dst", 4, 0, 10, stored=True)
    run = sssp_memo(layout, initial(e), partitions=4, broadcast_rows=0, min_hot_rows=10)
    senders = run.state.select(F.col("v").alias("src"), "d")
    with on_buckets(e.sparkSession), static_plan(e.sparkSession):
        plan = layout.expand(senders, 1)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        rows = run.memory.base.select("slot", "dst", "src", F.lit(1).alias("x"))
        plan = run.memory._beside(rows.repartition(3))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_a_message_may_depend_on_the_last_one(edges, monkeypatch):
    # Each message is one more than the last on its edge, up to three; so all edges are told three times.
    small_buckets(monkeypatch)
    e = edges(hub_rows())
    state = G.vertices_from_edges(e).select("v", F.lit(0.0).alias("heard"))
    got = []
    for bound in (0, 1_000_000):
        run = pregel_memo(
            e,
            state,
            send=lambda src, dst, weight, last: F.when(dst("heard") >= 0, F.least(F.coalesce(last + 1, F.lit(1.0)), F.lit(3.0))),
            digest=F.sum,
            update=lambda own, total, told: {"heard": F.when(told, total).otherwise(own("heard"))},
            receiver=["heard"],
            partitions=4,
            broadcast_rows=bound,
            min_hot_rows=10,
        )
        got.append((run.stats.frontier_sizes, as_dict(run.state, value="heard"), messages(run.memory.rows())))
    assert got[0] == got[1]
    assert set(got[0][2].values()) == {3.0} and len(got[0][0]) == 3


def test_a_run_leaves_one_memory_and_one_state(spark, edges, monkeypatch):
    small_buckets(monkeypatch)
    top = urlparse(checkpoint_dir(spark)).path
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(disk.getAllFiles().apply(i).getName().endswith(".data") for i in range(disk.getAllFiles().size()))

    rows = hub_rows()
    for bound in (0, 10, 1_000_000):
        e = edges(rows)
        state = initial(e)
        before, files = set(os.listdir(top)), shuffled()
        run = sssp_memo(e, state, partitions=4, broadcast_rows=bound, min_hot_rows=10)
        left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before)
        assert run.stats.rounds > 3
        assert left.count("memory") <= 1 and left.count("state") == 1 and not {"offered", "adjacency"} & set(left), left
        assert left.count("messages") <= len(run.memory.log), left
        # Only cached edges that were dealt out may still have theirs.
        assert shuffled() <= files + 4
        assert as_dict(run.state) == dijkstra(rows)


def test_a_small_run_merges_its_log_into_the_buckets(edges, monkeypatch):
    monkeypatch.setattr(memo, "MERGE_TABLES", 2)
    rows = [(i, i + 1, 1.0) for i in range(12)] + [(0, i, 20.0) for i in range(2, 13)]
    e = edges(rows)
    run = sssp_memo(e, initial(e))
    assert run.memory.base is not None and as_dict(run.state) == dijkstra(rows)
    assert messages(run.memory.rows()) == messages(memo_table(e, run.state))

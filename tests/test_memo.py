"""Message passing with remembered messages: fixpoint, warm starts, receivers and initial messages."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from deltapath.operators import graph as G
from deltapath.operators.messages import memo_table
from deltapath.plans import memo
from deltapath.plans.lineage import write_frontier
from deltapath.plans.memo import Memory, pregel_memo, sssp_memo
from deltapath.plans.pregel import NotConverged
from test_incremental_property import dijkstra, random_graph


def initial(e):
    return G.reset_flags(G.init_state(G.vertices_from_edges(e), 0))


def messages(df):
    return {(r.dst, r.src): r.msg for r in df.collect()}


@pytest.mark.parametrize(("seed", "broadcast_rows"), [(1, 1000), (2, 0)])
def test_cold_and_warm_runs_reach_the_fixpoint(edges, seed, broadcast_rows):
    rng = random.Random(seed)
    rows = random_graph(rng, 20, 60, zero_share=0.0)
    e = edges(rows)
    run = sssp_memo(e, initial(e), broadcast_rows=broadcast_rows, min_hot_rows=5)
    assert as_dict(run.state) == dijkstra(rows)
    assert messages(run.memory.rows()) == messages(memo_table(e, run.state))

    weights = {(a, b): w for a, b, w in rows}
    touched = rng.sample(sorted(weights), 6)
    for k in touched:
        weights[k] = float(rng.randint(1, 15))
    weights[(0, 19)] = 2.0
    new_rows = [(a, b, w) for (a, b), w in weights.items()]
    new = edges(new_rows)
    start = edges([(a, b, 1) for a, b in [*touched, (0, 19)]]).select(F.col("src").alias("v"))
    state = G.reset_flags(G.merge_vertices(new, run.state.drop("disturbed")))
    warm = sssp_memo(new, state, memory=run.memory, start=start, broadcast_rows=broadcast_rows, min_hot_rows=5)
    assert as_dict(warm.state) == dijkstra(new_rows)
    assert messages(warm.memory.rows()) == messages(memo_table(new, warm.state))


def test_only_changed_messages_are_sent(edges):
    # A star of 50: raising one edge on a warm memory sends that one message and those behind it.
    e = edges([(0, i, i) for i in range(1, 51)] + [(50, 51, 1)])
    run = sssp_memo(e, initial(e))
    assert run.stats.frontier_sizes == [50, 1]
    new = edges([(0, i, i) for i in range(1, 50)] + [(0, 50, 60), (50, 51, 1)])
    warm = sssp_memo(new, G.reset_flags(run.state), memory=run.memory)  # all vertices look at their edges
    assert warm.stats.frontier_sizes == [1, 1]
    assert as_dict(warm.state, value="disturbed") == {v: int(v in (50, 51)) for v in range(52)}


def test_forgotten_messages(spark, edges):
    e = edges([(0, 1, 1), (0, 2, 5), (1, 2, 1), (2, 3, 1)])
    run = sssp_memo(e, initial(e))
    less = edges([(0, 1, 1), (0, 2, 5), (2, 3, 1)])
    nobody = spark.createDataFrame([], "v bigint")
    gone = spark.createDataFrame([(2, 1)], "dst bigint, src bigint")
    warm = sssp_memo(less, run.state, memory=run.memory, start=nobody, forgotten=gone)
    assert as_dict(warm.state) == {0: 0.0, 1: 1.0, 2: 5.0, 3: 6.0}
    assert messages(warm.memory.rows()) == {(1, 0): 1.0, (2, 0): 5.0, (3, 2): 6.0}


def test_send_reads_the_receiver_and_all_take_an_initial_message(edges):
    # Each vertex starts with the initial label and takes the least label of a smaller in-neighbour, told only to larger receivers.
    e = edges([(1, 2, 1), (2, 1, 1), (2, 3, 1), (5, 4, 1)])
    state = G.vertices_from_edges(e).select("v", F.lit(None).cast("double").alias("label"), F.lit(0).alias("heard"))
    run = pregel_memo(
        e,
        state,
        send=lambda src, dst, weight, last: F.when(src("label") < dst("label"), src("label")),
        digest=F.min,
        update=lambda own, least, got: {
            "label": F.when(got, F.least(own("label"), least)).otherwise(F.coalesce(own("label"), least + own("v"))),
            "heard": F.when(got, own("heard") + 1).otherwise(own("heard")),
        },
        initial=F.lit(100.0),
        watch=["label"],
        receiver=["label"],
    )
    got = {r.v: (r.label, r.heard) for r in run.state.collect()}
    assert got == {1: (101.0, 0), 2: (101.0, 1), 3: (101.0, 2), 4: (104.0, 0), 5: (105.0, 0)}


def test_round_limit(edges):
    e = edges([(i, i + 1, 1) for i in range(6)])
    with pytest.raises(NotConverged):
        sssp_memo(e, initial(e), max_rounds=2)


def test_memory_merges_its_log(spark):
    memory, want = Memory(4, 100), {}
    for k in range(30):
        rows = [(i, i + 1, float(k)) for i in range(k % 5, 40, 5)] + ([(1, 2, None)] if k == 29 else [])
        rows = list({(a, b): (a, b, m) for a, b, m in rows}.values())
        want.update({(a, b): m for a, b, m in rows})
        memory.add(spark.createDataFrame(rows, "dst bigint, src bigint, msg double"), len(rows))
    assert len(memory.log) <= 13
    assert messages(memory.rows()) == {k: m for k, m in want.items() if m is not None}


def test_nothing_is_looked_up_while_nothing_is_remembered(edges, monkeypatch):
    e = edges([(i, i + 1, 1.0) for i in range(30)])
    written = []

    def seen(df, name="frontier", static=False):
        out = write_frontier(df, name, static)
        written.append((name, out[1]))
        return out

    monkeypatch.setattr(memo, "write_frontier", seen)
    run = sssp_memo(e, initial(e), 0, max_rounds=30)
    assert as_dict(run.state)[30] == 30.0
    # In the first round every vertex is asked, and only the source sends.
    assert [n for n in written if n[0] in ("offered", "messages")][0] == ("messages", 1)
    assert max(n for name, n in written if name == "offered") == 1


def test_a_round_reads_the_log_in_one_scan(spark):
    memory, want = Memory(4, 100), {}
    first = [(i, 0, 1.0) for i in range(400)]
    memory.add(spark.createDataFrame(first, "dst bigint, src bigint, msg double"), len(first))
    memory.merge()
    want.update({(a, b): m for a, b, m in first})
    plans = []
    for k in range(10):
        rows = [(k, 0, 2.0 + k), (50, 0, float(k)), (60, k, None if k == 0 else 3.0)]
        df = spark.createDataFrame(rows, "dst bigint, src bigint, msg double").coalesce(1)
        memory.add(*write_frontier(memory.aged(df), "a log%20"))
        want.update({(a, b): m for a, b, m in rows})
        plans.append(memory.rows()._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
    assert len(memory.log) == 10 and plans[-1] == plans[1]
    assert messages(memory.rows()) == {k: m for k, m in want.items() if m is not None}
    memory.merge()
    memory.add(spark.createDataFrame([(50, 0, 7.0)], "dst bigint, src bigint, msg double"), 1)
    memory.add(*write_frontier(memory.aged(spark.createDataFrame([(50, 0, 8.0)], "dst bigint, src bigint, msg double")), "log"))
    assert messages(memory.rows())[50, 0] == 8.0

"""Deep graphs: several hops in a job, exact, with a parent forest, from whole runs and from batches."""

import random

import pytest

from conftest import as_dict
from deltapath import catalog
from deltapath.plans import sssp as S
from deltapath.plans.live import LiveDistances
from deltapath.sources import fixtures as X
from test_incremental_property import dijkstra


def deep_graph(n, seed):
    """A chain with light and heavy shortcuts, edges back and edges without weight."""
    rng = random.Random(seed)
    weights = {(i, i + 1): float(rng.randint(0, 3)) for i in range(n)}
    for _ in range(n):
        a = rng.randrange(n)
        weights.setdefault((a, min(n, a + rng.randint(2, 5))), float(rng.randint(1, 12)))
        weights.setdefault((a, max(1, a - rng.randint(1, 9))), float(rng.randint(0, 2)))
    return [(a, b, w) for (a, b), w in weights.items() if a != b]


def check_forest(state, rows):
    """Each parent's distance and edge give the vertex its own, and every path of parents ends in the source."""
    weights = {(a, b): w for a, b, w in rows}
    d, parent = ({r.v: r[c] for r in state} for c in ("d", "parent"))
    for v, up in parent.items():
        assert up is None or d[v] == d[up] + weights[up, v]
        seen = set()
        while up is not None:
            assert up not in seen
            seen.add(up)
            up = parent[up]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_job_takes_several_hops(edges, seed):
    rows = deep_graph(90, seed)
    stats = S.RunStats()
    state = S.sssp_state(edges(rows), stats=stats).collect()
    assert {r.v: r.d for r in state} == dijkstra(rows)
    check_forest(state, rows)
    assert S.STEPWISE_ROUNDS < stats.rounds <= S.STEPWISE_ROUNDS + 90 // S.HOPS_PER_JOB + 2


def test_a_hot_key_keeps_to_single_hops(edges):
    rows = deep_graph(20, 3) + [(20, 100 + i, 1.0) for i in range(60)]
    assert as_dict(S.sssp(edges(rows), min_hot_rows=30)) == dijkstra(rows)


def test_a_deep_batch_reads_a_bounded_overlay(edges, updates, monkeypatch):
    rows = deep_graph(60, 4)
    live = LiveDistances.build(edges(rows))
    read = []
    from deltapath.plans import live as module

    def seen(like, paths, real=module.read_overlay):
        read.append(len(paths))
        return real(like, paths)

    monkeypatch.setattr(module, "read_overlay", seen)
    first = min(rows)
    after = live.upsert(updates([(first[0], first[1], first[2] + 40, 1), (60, 61, 1, 1)])).after
    lower = after.upsert(updates([(first[0], first[1], first[2], 2)])).after
    new = [*rows, (60, 61, 1.0)]
    raised = [(first[0], first[1], first[2] + 40) if r == first else r for r in new]
    for got, want in ((after, raised), (lower, new)):
        state = got.state.collect()
        assert {r.v: r.d for r in state} == dijkstra(want)
        check_forest(state, want)
    assert max(read) <= S.STEPWISE_ROUNDS + 8  # one table a round, and those of the invalidated vertices


def test_update_files_do_not_grow_with_the_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "range_count", lambda events: 40)
    folder = catalog._write_update_files(spark, "/root/testdata/sf0.001")
    assert len(spark.read.text(folder).inputFiles()) <= 4
    assert spark.read.text(folder).count() == X.update_stream(catalog._t(spark, "/root/testdata/sf0.001")).count()

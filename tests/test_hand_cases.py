"""Hand-made cases for the hazards of the original algorithms (FIXTURES.md §3)."""

import pytest

from conftest import as_dict
from deltapath.operators import changes as C
from deltapath.plans import hops as H
from deltapath.plans import incremental as I
from deltapath.plans import sssp as S


def run(e):
    return as_dict(S.sssp(e, 0))


def update(e, u):
    prev = S.sssp_state(e, 0)
    new_edges, state = I.sssp_after_update(prev, e, u, 0)
    return as_dict(state.select("v", "d"))


def test_root_on_cycle_is_pinned(edges):
    assert run(edges([(0, 1, 1), (1, 0, 1)])) == {0: 0.0, 1: 1.0}


def test_parallel_edges_collapse_to_min(edges):
    assert run(edges([(0, 1, 1), (0, 1, 2)])) == {0: 0.0, 1: 1.0}


def test_zero_weight_cycle_raise(edges, updates):
    e = edges([(0, 1, 5), (1, 2, 0), (2, 1, 0)])
    got = update(e, updates([(0, 1, 10, 1)]))
    assert got == {0: 0.0, 1: 10.0, 2: 10.0}


def test_positive_cycle_raise(edges, updates):
    e = edges([(0, 1, 1), (1, 2, 1), (2, 1, 1), (0, 2, 40)])
    got = update(e, updates([(0, 1, 100, 1)]))
    assert got == {0: 0.0, 1: 41.0, 2: 40.0}


def test_last_write_wins_by_seq(edges, updates):
    e = edges([(0, 1, 1)])
    got = update(e, updates([(0, 1, 3, 2), (0, 1, 7, 1)]))
    assert got == {0: 0.0, 1: 3.0}


def test_update_of_missing_edge_is_ignored(edges, updates):
    e = edges([(0, 1, 1)])
    u = updates([(1, 9, 2, 1)])
    assert update(e, u) == {0: 0.0, 1: 1.0}
    assert C.unknown_updates(e, u).count() == 1


def test_long_chain_has_no_stage_cap(edges):
    e = edges([(i, i + 1, 1) for i in range(14)])
    assert run(e) == {i: float(i) for i in range(15)}


@pytest.mark.parametrize("w", [float("nan"), -1.0])
def test_bad_weight_is_rejected(edges, w):
    with pytest.raises(Exception, match="non-negative"):
        S.sssp(edges([(0, 1, w)]), 0).collect()


def test_root_without_edges(edges):
    assert run(edges([(3, 4, 1)])) == {0: 0.0, 3: None, 4: None}


def test_unreached_component(edges):
    assert run(edges([(0, 1, 1), (5, 6, 1)])) == {0: 0.0, 1: 1.0, 5: None, 6: None}


def test_repeat_run_changes_nothing(edges):
    e = edges([(0, 1, 1), (1, 2, 2), (0, 2, 5)])
    prev = S.sssp_state(e, 0)
    again = I.update_sssp(prev, e, e, 0)
    assert as_dict(again.select("v", "d")) == as_dict(prev.select("v", "d"))
    dist = prev.select("v", "d")
    assert I.disturbed_vertices(e, dist, e, again.select("v", "d")).count() == 0


def test_empty_graph(edges):
    e = edges([])
    assert run(e) == {0: 0.0}
    dist = S.sssp(e, 0)
    assert I.count_disturbed(I.disturbed_vertices(e, dist, e, dist)).first()["n"] == 0


def test_diamond_and_raise(edges, updates):
    e = edges([(0, 1, 1), (0, 2, 5), (1, 2, 1), (2, 3, 1)])
    assert run(e) == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    assert update(e, updates([(0, 1, 9, 1)])) == {0: 0.0, 1: 9.0, 2: 5.0, 3: 6.0}


def test_two_depths_staged_vs_shortest(edges):
    e = edges([(0, 2, 1), (0, 1, 5), (1, 2, 1)])
    assert run(e) == {0: 0.0, 1: 5.0, 2: 1.0}
    hops = H.hop_distances(e, 0, 10)
    by_k = {(r["v"], r["k"]): r["d"] for r in hops.collect()}
    assert by_k == {(1, 1): 5.0, (2, 1): 1.0, (2, 2): 6.0}
    assert as_dict(H.last_stage_distance(hops)) == {1: 5.0, 2: 6.0}


def test_insert_new_vertex(edges):
    e = edges([(0, 1, 1)])
    new = C.create_edges(e, edges([(1, 7, 2)]))
    prev = S.sssp_state(e, 0)
    got = as_dict(I.update_sssp(prev, e, new, 0).select("v", "d"))
    assert got == {0: 0.0, 1: 1.0, 7: 3.0}


def test_hop_count_is_unit_weight(edges):
    e = edges([(0, 1, 10), (1, 2, 10), (0, 2, 100)])
    assert as_dict(S.hop_count(e, 0)) == {0: 0.0, 1: 1.0, 2: 1.0}

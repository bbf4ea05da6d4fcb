"""Property: incremental results equal a full recompute on the changed edges."""

import random

import pytest

from conftest import as_dict
from deltapath.operators import changes as C
from deltapath.plans import hops as H
from deltapath.plans import incremental as I
from deltapath.plans import sssp as S


def dijkstra(rows, source=0):
    import heapq

    adj = {}
    verts = {source}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
        verts.update((a, b))
    dist = {v: None for v in verts}
    dist[source] = 0.0
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in adj.get(u, []):
            nd = d + w
            if dist[v] is None or nd < dist[v]:
                dist[v] = nd
                heapq.heappush(heap, (nd, v))
    return dist


def random_graph(rng, n, m, zero_share=0.2):
    keys = {}
    for _ in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        if a == b:
            continue
        keys[(a, b)] = 0.0 if rng.random() < zero_share else float(rng.randint(1, 9))
    return [(a, b, w) for (a, b), w in keys.items()]


def mixed_batch(rng, rows, n, k):
    keys = {(a, b): w for a, b, w in rows}
    items = list(keys)
    for _ in range(k):
        op = rng.choice(["raise", "lower", "insert", "delete"])
        if op in ("raise", "lower", "delete") and items:
            key = rng.choice(items)
            if key not in keys:
                continue
            if op == "delete":
                del keys[key]
            elif op == "raise":
                keys[key] = keys[key] + rng.randint(1, 20)
            else:
                keys[key] = float(rng.randint(0, int(keys[key])))
        else:
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                keys[(a, b)] = float(rng.randint(0, 9))
    return [(a, b, w) for (a, b), w in keys.items()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_update_equals_full_recompute(edges, seed):
    rng = random.Random(seed)
    n = 25
    old_rows = random_graph(rng, n, 70)
    new_rows = mixed_batch(rng, old_rows, n, 12)
    old, new = edges(old_rows), edges(new_rows)
    prev = S.sssp_state(old, 0)
    assert as_dict(prev.select("v", "d")) == dijkstra(old_rows)
    got = as_dict(I.update_sssp(prev, old, new, 0).select("v", "d"))
    assert got == dijkstra(new_rows)


def test_rebuild_path_matches(edges):
    rng = random.Random(7)
    old_rows = [(i, i + 1, 1.0) for i in range(12)]
    new_rows = [(0, 1, 50.0)] + old_rows[1:]
    old, new = edges(old_rows), edges(new_rows)
    stats = S.RunStats()
    got = I.update_sssp(S.sssp_state(old, 0), old, new, 0, stats=stats)
    assert stats.extra["invalidated"] > 0
    assert as_dict(got.select("v", "d")) == dijkstra(new_rows)
    del rng


def test_hop_update_equals_full(edges, updates):
    rng = random.Random(5)
    rows = random_graph(rng, 20, 60, zero_share=0.0)
    e = edges(rows)
    u = updates([(a, b, w + 3.0, i) for i, (a, b, w) in enumerate(rows[:8])])
    new = C.update_edge_batch(e, u)
    inc = H.update_hop_distances(H.hop_distances(e, 0, 6), e, new, 0, 6)
    full = H.hop_distances(new, 0, 6)
    assert sorted(map(tuple, inc.collect())) == sorted(map(tuple, full.collect()))


@pytest.mark.parametrize("seed", [11])
def test_disturbed_matches_full_memo_compare(edges, seed):
    rng = random.Random(seed)
    old_rows = random_graph(rng, 20, 60)
    new_rows = mixed_batch(rng, old_rows, 20, 10)
    old, new = edges(old_rows), edges(new_rows)
    d_old = S.sssp(old, 0)
    d_new = S.sssp(new, 0)
    fast = {r["v"] for r in I.disturbed_vertices(old, d_old, new, d_new).collect()}
    full = {r["dst"] for r in I.changed_memo(old, d_old, new, d_new).collect()}
    assert fast == full

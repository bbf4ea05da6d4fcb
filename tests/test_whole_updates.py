"""Queries on the update batch take every event after nine tenths of the event ids."""

import heapq
from datetime import datetime, timedelta

import pytest

from deltapath.catalog import QUERIES

INF = float("inf")


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """A table of events, and by plain Python its edges before and after the updates and the updates' sources."""
    rows = []
    for i in range(1, 601):
        user = (i * i * 7 + i // 3) % 40 if i % 5 else 0
        rows.append((i, datetime(2024, 1, 1) + timedelta(minutes=11 * i), user, float((i * 37) % 23)))
    folder = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    cut = rows[-1][0] * 9 // 10
    old, new = {}, {}
    for (i, t, u, value), (_, t2, u2, _) in zip(rows, rows[1:]):
        if t.date() != t2.date() or u == u2:
            continue
        if i <= cut:
            old[u, u2] = min(old.get((u, u2), INF), value // 1 + 1)
        else:
            new[u, u2] = value // 1 + 1
    return str(folder), old, {**old, **new}, {u for u, _ in new}


def distances(edges):
    best, heap = {}, [(0.0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for (a, b), w in edges.items():
                if a == v and b not in best:
                    heapq.heappush(heap, (d + w, b))
    return best


def messages(edges, dist):
    return {(b, a): dist[a] + w for (a, b), w in edges.items() if a in dist}


def run(spark, graph, name):
    return [tuple(r) for r in QUERIES[name](spark, graph[0]).collect()]


def test_vertex_step_of_all_updates(spark, graph):
    _, old, new, _ = graph
    before = messages(old, distances(old))
    now = messages(new, distances(old))
    hit = {b for (b, a), m in now.items() if before.get((b, a)) != m}
    want = {b: min(m for (x, _), m in {**before, **now}.items() if x == b) for b in hit}
    if 0 in want:
        want[0] = 0.0
    assert dict(run(spark, graph, "vertex_step")) == want


def test_affected_sources_of_all_updates(spark, graph):
    _, old, _, sources = graph
    known = {v for e in old for v in e}
    assert sorted(run(spark, graph, "affected_sources")) == sorted((v,) for v in sources & known)


def disturbed(graph):
    _, old, new, _ = graph
    before, now = messages(old, distances(old)), messages(new, distances(new))
    return {e[0] for e in {*before, *now} if before.get(e) != now.get(e)}


def test_disturbed_vertices_of_all_updates(spark, graph):
    assert sorted(run(spark, graph, "disturbed_vertices")) == sorted((v,) for v in disturbed(graph))


def test_disturbed_flags_of_all_updates(spark, graph):
    _, old, new, _ = graph
    hit, dist = disturbed(graph), distances(new)
    assert sorted(run(spark, graph, "disturbed_flags")) == sorted((v, dist.get(v), int(v in hit)) for v in {v for e in new for v in e} | {0})


def test_count_of_disturbed_vertices_of_all_updates(spark, graph):
    assert run(spark, graph, "count_disturbed") == [(len(disturbed(graph)),)]

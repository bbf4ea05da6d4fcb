"""The part/supplier graph and what its queries do with it once it is laid out."""

import math

import pytest

from deltapath import catalog
from deltapath.operators import graph as G
from deltapath.operators import messages as M
from deltapath.operators.adjacency import Adjacency
from deltapath.sources import fixtures as X
from deltapath.sources.tables import Tables

SCHEMA = "l_partkey bigint, l_suppkey bigint, l_quantity double"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.fixture
def folder(spark, tmp_path):
    return write(spark, tmp_path, [(i % 7, i * i % 5, float(1 + i * 3 % 11)) for i in range(60)])


def test_collapsed_edges_keep_nulls_and_copies(spark, tmp_path):
    rows = [(1, 2, 5.0), (1, 2, 3.0), (1, 2, 3.0), (4, 0, None), (4, 0, 7.0), (6, 1, None), (None, 3, 2.0), (2, None, 1.0), (None, None, 9.0), (None, None, 8.0)]
    want = {}
    for p, s, w in rows:
        part, supplier = None if p is None else 2 * p + 1, None if s is None else 2 * s
        for e in {(part, supplier), (supplier, part)}:
            want[e] = min([x for x in (want.get(e), w) if x is not None], default=None)
    got = [tuple(r) for r in X.g_ps(Tables(spark, write(spark, tmp_path, rows))).collect()]
    assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want


def test_pairs_are_dealt_out_by_their_number(spark, folder, monkeypatch):
    monkeypatch.setattr(X, "PAIR_ROWS", 3)
    edges = X.g_ps(Tables(spark, folder))
    assert edges.rdd.getNumPartitions() == math.ceil(60 / 3)
    assert edges.count() == edges.select("src", "dst").distinct().count() > 0


@pytest.mark.parametrize("name", ["sssp", "hop_distances", "triplets"])
def test_edges_are_collapsed_once(spark, folder, monkeypatch, name):
    want = sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())
    monkeypatch.setattr(G, "collapse_parallel", lambda edges: pytest.fail("edges without parallel ones are collapsed again"))
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()) == want


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_steps_over_laid_out_edges(spark, edges, bound):
    table = edges([(i % 9, i * 5 % 11, 1 + i % 4) for i in range(50)]).dropDuplicates(["src", "dst"])
    state = spark.createDataFrame([(v, None if v % 3 == 2 else v / 2) for v in range(11)], "v bigint, d double")
    layout = Adjacency.build(table, broadcast_rows=bound, min_hot_rows=1)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(M.candidate_messages(layout, state)) == rows(M.candidate_messages(table, state))
    assert rows(G.triplets(layout, state)) == rows(G.triplets(table, state))

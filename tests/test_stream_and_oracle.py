"""Streaming replay and a sample of the registered queries against DuckDB."""

import time
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as E
from conftest import as_dict
from deltapath.catalog import QUERIES
from deltapath.oracle import ORACLE
from deltapath.session import scratch_path
from deltapath.sources.tables import TABLES
from deltapath.streaming import file_update_stream, print_head
from deltapath.streaming.store import Folder, Store, Version
from deltapath.streaming.updates import DistanceMaintainer
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def checkpoint_of(tmp_path, name: str) -> str:
    """A checkpoint folder as a streaming query has it."""
    (tmp_path / name).mkdir()
    (tmp_path / name / "metadata").write_text('{"id":"%s"}' % name)
    return f"file://{tmp_path}/{name}"


def test_stream_batch_replay_is_idempotent(spark, edges, updates, tmp_path):
    m = DistanceMaintainer(scratch_path(spark, "t-stream"), checkpoint_of(tmp_path, "q"))
    m.initialize(edges([(0, 1, 5), (1, 2, 1)]))
    batch = updates([(0, 1, 1, 10), (2, 3, 1, 11)])
    m(batch, 0)
    m(batch, 0)  # replay of a committed batch id
    version, e, dist = m.latest(spark)
    assert version == 1
    assert as_dict(dist) == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    older = updates([(0, 1, 9, 3)])  # older seq than the stored update: ignored
    m(older, 1)
    _, _, dist2 = m.latest(spark)
    assert as_dict(dist2)[1] == 1.0


def test_batch_of_a_new_checkpoint_is_not_taken_for_a_replay(spark, edges, updates, tmp_path):
    state = scratch_path(spark, "t-stream")
    a, b = (DistanceMaintainer(state, checkpoint_of(tmp_path, name)) for name in ("first", "second"))
    a.initialize(edges([(0, 1, 5)]))
    a(updates([(0, 1, 1, 10)]), 0)
    b(updates([(0, 1, 3, 11)]), 0)  # batch 0 of another query; its state is read from the folder
    b(updates([(0, 1, 9, 12)]), 0)  # replay
    _, _, dist = b.latest(spark)
    assert as_dict(dist)[1] == 3.0


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", ["write_delta", "compacted", "commit", "_clean"])
def test_a_batch_that_dies_between_two_writes_is_done_by_the_next_try(spark, edges, updates, tmp_path, monkeypatch, at):
    state, checkpoint = scratch_path(spark, "t-stream"), checkpoint_of(tmp_path, "q")
    first = DistanceMaintainer(state, checkpoint)
    first.initialize(edges([(0, 1, 5), (1, 2, 1), (0, 2, 9)]))
    batch = updates([(0, 1, 20, 10), (2, 3, 1, 11)])
    calls = []

    def dies(self, *args, real=getattr(Store, at)):
        calls.append(1)
        out = real(self, *args) if at in ("write_delta", "_clean") else None
        if len(calls) == (2 if at == "write_delta" else 1):
            raise Crash
        return out

    with monkeypatch.context() as patch:
        patch.setattr(Store, at, dies)
        with pytest.raises(Crash):
            first(batch, 0)
    second = DistanceMaintainer(state, checkpoint)
    second(batch, 0)
    version, e, dist = second.latest(spark)
    assert version == 1
    assert as_dict(dist) == {0: 0.0, 1: 20.0, 2: 9.0, 3: 10.0}
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {(0, 1): 20.0, (1, 2): 1.0, (0, 2): 9.0, (2, 3): 1.0}


def test_a_batch_writes_by_its_own_size_and_files_stay_bounded(spark, tmp_path, edges, updates, monkeypatch):
    state = scratch_path(spark, "t-stream")
    m = DistanceMaintainer(state, checkpoint_of(tmp_path, "q"))
    m.initialize(edges([(0, i, 1 + i % 5) for i in range(1, 6000)] + [(i, i + 10_000, 1) for i in range(1, 6000)]))
    folder = Folder(spark, state)
    base = folder.size("edges") + folder.size("dist")
    for k in range(2):
        m(updates([(0, 10 + k, 9, k), (5000, 30_000 + k, 1, k)]), k)
    written = folder.size("edges") + folder.size("dist") - base
    assert len(folder.names("edges")) == 3  # a base and two deltas
    assert written < base / 10
    monkeypatch.setattr("deltapath.streaming.store.COMPACT_DELTAS", 1)
    monkeypatch.setattr("deltapath.streaming.store.KEEP_VERSIONS", 1)
    for k in range(2, 4):
        m(updates([(0, 10 + k, 9, k)]), k)
        assert len(folder.names("edges")) <= 3 and len(folder.names("dist")) <= 3 and len(folder.names("versions")) == 1
    version, e, dist = DistanceMaintainer(state, m.checkpoint).latest(spark)
    got = as_dict(dist)
    assert version == 4 and [got[10 + k] for k in range(4)] == [9.0] * 4 and got[5000] == 1.0 and got[30_001] == 2.0
    assert e.count() == 2 * 5999 + 2


def test_two_writers_cannot_commit_the_same_version(spark):
    store = Store(spark, scratch_path(spark, "t-store"), [])
    store.commit(Version(0, {}))
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(Version(0, {}))


def test_head_of_each_batch_on_the_five_second_trigger(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"u{k}.txt").write_text("".join(f"{k} {i} 1.0 {i}\n" for i in range(15)))
    said = []
    stream = file_update_stream(spark, f"file://{tmp_path}", max_files_per_trigger=1)
    query = print_head(stream, scratch_path(spark, "t-head"), rows=10, out=said.append)
    try:
        done = []
        for _ in range(600):
            done = [p.timestamp for p in query.recentProgress if p.numInputRows]
            if len(done) == 2:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert [len(text.splitlines()) for text in said] == [11, 11]  # a heading and ten rows of fifteen
    assert said[0].splitlines()[0] == "batch 0" and len(said[0].splitlines()[1].split()) == 4
    # Though its file was there, the second batch has waited for the next whole multiple of the interval.
    first, second = (datetime.fromisoformat(t.replace("Z", "+00:00")).timestamp() for t in done)
    assert second >= first // 5 * 5 + 5


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["v", "d"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize(
    "name",
    ["sssp", "nary_tree", "hop_distances", "upsert_edges", "sssp_after_update", "disturbed_vertices", "merge_memo", "pregel_memo_after_update"],
)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ocols, res.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)

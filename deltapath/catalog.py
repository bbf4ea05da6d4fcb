"""The registered queries: one per operator of the inventory, each over the given tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the oracle SQL of the same name (``deltapath.oracle``).  Graphs come
from the relational tables (``deltapath.sources.fixtures``); the source
vertex is always 0 and the hop-staged queries use 10 stages.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes as C
from .operators.adjacency import Adjacency
from .operators import graph as G
from .operators import messages as M
from .operators import sinks as K
from .plans import hops as H
from .plans import incremental as I
from .plans import memo as N
from .plans import pregel as P
from .plans import sssp as S
from .plans.lineage import cut, persist
from .plans.live import Change, LiveDistances, batch_changes
from .session import num_partitions, scratch_path
from .sources import fixtures as X
from .sources import generators, text
from .sources.tables import Tables
from .streaming import updates as U

SOURCE = 0
MAX_HOPS = 10
TREE_DEGREE = 3

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def _ev(spark: SparkSession, sf_dir: str, with_updates: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Cached (g_ev, raw update stream); their lineage is a deterministic scan of the tables."""
    t = _t(spark, sf_dir)
    base, upd = X.g_ev_parts(t)
    edges = persist(base.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    return edges, (persist(upd) if with_updates else None)


def _latest(upd: DataFrame) -> DataFrame:
    return C.latest_updates(upd).select("src", "dst", "weight")


def _dist(state: DataFrame) -> DataFrame:
    return state.select("v", "d")


# --- sources ---------------------------------------------------------------------------

def scan_edge_text(spark, sf_dir):
    path = scratch_path(spark, "edges-text")
    text.write_edge_text(X.g_tree(_t(spark, sf_dir)), path)
    return text.read_edge_text(spark, path)


def graph_from_text(spark, sf_dir):
    path = scratch_path(spark, "edges-text")
    text.write_edge_text(X.g_tree(_t(spark, sf_dir)), path)
    edges = text.read_edge_text(spark, path)
    return G.init_state(G.vertices_from_edges(edges), SOURCE)


def scan_updates(spark, sf_dir):
    path = scratch_path(spark, "updates-text")
    text.write_update_text(X.update_stream(_t(spark, sf_dir)), path)
    return text.read_update_text(spark, path)


def nary_tree(spark, sf_dir):
    return generators.tree_over(_t(spark, sf_dir).orders, "o_orderkey", TREE_DEGREE)


# --- graph construction ---------------------------------------------------------------

def vertices_from_edges(spark, sf_dir):
    return G.vertices_from_edges(X.g_ps(_t(spark, sf_dir)))


def init_state(spark, sf_dir):
    return G.init_state(G.vertices_from_edges(X.g_ps(_t(spark, sf_dir))), SOURCE)


def _ps_state(spark, sf_dir) -> tuple[Adjacency, DataFrame]:
    """g_ps laid out once, for the distances and for what is done with them."""
    layout = Adjacency.build(G.prepare_edges(X.g_ps(_t(spark, sf_dir)), collapse=False))
    return layout, _dist(S.sssp_on(layout, SOURCE))


def triplets(spark, sf_dir):
    edges, dist = _ps_state(spark, sf_dir)
    return G.triplets(edges, dist)


def reset_flags(spark, sf_dir):
    _, dist = _ps_state(spark, sf_dir)
    return G.reset_flags(dist)


def merge_vertices(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    old = _dist(S.sssp_state(edges, SOURCE))
    return G.merge_vertices(C.upsert_edges(edges, upd), old)


# --- message passing ------------------------------------------------------------------

def candidate_messages(spark, sf_dir):
    edges, dist = _ps_state(spark, sf_dir)
    return M.candidate_messages(edges, dist)


def aggregate_messages(spark, sf_dir):
    edges, dist = _ps_state(spark, sf_dir)
    return M.aggregate_messages(M.candidate_messages(edges, dist))


def memo_table(spark, sf_dir):
    edges, dist = _ps_state(spark, sf_dir)
    return M.memo_table(edges, dist)


def min_message(spark, sf_dir):
    edges, dist = _ps_state(spark, sf_dir)
    return M.min_message(M.memo_table(edges, dist), SOURCE)


def _one_step(spark, sf_dir) -> dict:
    """One memo step: fixpoint before the updates, new edges (upserted), changed messages."""
    edges, upd = _ev(spark, sf_dir)
    old = cut(_dist(S.sssp_state(edges, SOURCE)))
    new_edges = persist(C.upsert_edges(edges, upd))
    state = G.merge_vertices(new_edges, old)
    memo = M.memo_table(edges, old)
    changed = M.changed_messages(M.candidate_messages(new_edges, old), memo)
    merged = M.merge_memo(memo, changed)
    stepped = M.vertex_step(state, changed, merged, SOURCE)
    return {"state": state, "memo": memo, "changed": changed, "merged": merged, "stepped": stepped}


def changed_messages(spark, sf_dir):
    return _one_step(spark, sf_dir)["changed"]


def merge_memo(spark, sf_dir):
    return _one_step(spark, sf_dir)["merged"]


def vertex_step(spark, sf_dir):
    return _one_step(spark, sf_dir)["stepped"]


def merge_state(spark, sf_dir):
    s = _one_step(spark, sf_dir)
    return M.merge_state(s["state"], s["stepped"])


def active_frontier(spark, sf_dir):
    s = _one_step(spark, sf_dir)
    return M.active_frontier(s["state"], s["stepped"])


def affected_sources(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return C.affected_sources(upd, G.vertices_from_edges(edges))


def pregel_min(spark, sf_dir):
    edges = persist(X.g_ps(_t(spark, sf_dir)))
    initial = G.init_state(G.vertices_from_edges(edges), SOURCE).withColumnRenamed("d", "value")
    return P.pregel(edges, initial).withColumnRenamed("value", "d")


def pregel_memo(spark, sf_dir):
    """The memory of every edge after a change-only run from the initial state."""
    layout = Adjacency.build(G.prepare_edges(X.g_ps(_t(spark, sf_dir)), collapse=False), stored=True)
    initial = G.reset_flags(G.init_state(G.vertices_from_edges(layout.base), SOURCE))
    return N.sssp_memo(layout, initial, SOURCE).memory.rows().select("dst", "src", "msg")


def pregel_memo_after_update(spark, sf_dir):
    """Distances after the updates, from the remembered messages: the sources of updated edges send first."""
    edges, upd = _ev(spark, sf_dir)
    run = N.sssp_memo(edges, G.reset_flags(G.init_state(G.vertices_from_edges(edges), SOURCE)), SOURCE)
    new_edges = persist(C.upsert_edges(edges, upd))
    state = G.reset_flags(G.merge_vertices(new_edges, run.state))
    return _dist(N.sssp_memo(new_edges, state, SOURCE, memory=run.memory, start=upd.select(F.col("src").alias("v"))).state)


# --- edge changes -----------------------------------------------------------------------

def update_edge(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    last = upd.agg(F.max_by(F.struct("src", "dst", "weight", "seq"), "seq").alias("u")).select("u.*")
    return C.update_edge(edges, last)


def update_edge_batch(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return C.update_edge_batch(edges, upd)


def create_edges(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return C.create_edges(edges, C.unknown_updates(edges, upd).select("src", "dst", "weight"))


def edge_union_all(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return C.edge_union_all(edges, _latest(upd))


def upsert_edges(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return C.upsert_edges(edges, upd)


# --- distances --------------------------------------------------------------------------

def sssp(spark, sf_dir):
    return _dist(S.sssp_state(X.g_ps(_t(spark, sf_dir)), SOURCE, collapse=False))


def sssp_tree(spark, sf_dir):
    return _dist(S.sssp_state(X.g_tree(_t(spark, sf_dir)), SOURCE))


def sssp_events(spark, sf_dir):
    return _dist(S.sssp_state(X.g_transitions(_t(spark, sf_dir)), SOURCE))


def hop_count(spark, sf_dir):
    return S.hop_count(X.g_ps(_t(spark, sf_dir)), SOURCE, collapse=False)


def sssp_after_update(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    return LiveDistances.build(edges, SOURCE).update(upd).after.distances()


def sssp_after_insert(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    added = C.unknown_updates(edges, upd).select("src", "dst", "weight")
    return LiveDistances.build(edges, SOURCE).insert(added).after.distances()


def hop_distances(spark, sf_dir):
    return H.hop_distances(X.g_ps(_t(spark, sf_dir)), SOURCE, MAX_HOPS, collapse=False)


def last_stage_distance(spark, sf_dir):
    return H.last_stage_distance(hop_distances(spark, sf_dir))


def stage_message_counts(spark, sf_dir):
    return H.stage_message_counts(hop_distances(spark, sf_dir))


def stage_messages(spark, sf_dir):
    edges = persist(X.g_ps(_t(spark, sf_dir)))
    return H.stage_messages(edges, H.hop_distances(edges, SOURCE, MAX_HOPS), SOURCE, MAX_HOPS)


def hop_distances_after_update(spark, sf_dir):
    edges, upd = _ev(spark, sf_dir)
    layout = Adjacency.build(edges)
    old_hops = H.hop_distances(edges, SOURCE, MAX_HOPS, adjacency=layout)
    return H.hops_after_changes(old_hops, layout, *batch_changes(layout, upd, insert=False), SOURCE, MAX_HOPS)[0]


# --- run metrics --------------------------------------------------------------------------

def _batch(spark, sf_dir) -> Change:
    """What the updates do to the distances."""
    edges, upd = _ev(spark, sf_dir)
    return LiveDistances.build(edges, SOURCE).upsert(upd)


def _disturbed(spark, sf_dir) -> DataFrame:
    return _batch(spark, sf_dir).disturbed()


def disturbed_flags(spark, sf_dir):
    change = _batch(spark, sf_dir)
    return I.disturbed_flags(change.after.distances(), change.disturbed())


def disturbed_vertices(spark, sf_dir):
    path = scratch_path(spark, "disturbed")
    K.write_disturbed(_disturbed(spark, sf_dir), path)
    return spark.read.parquet(path)


def count_disturbed(spark, sf_dir):
    return I.count_disturbed(_disturbed(spark, sf_dir))


# --- sinks ---------------------------------------------------------------------------------

def sink_distances(spark, sf_dir):
    path = scratch_path(spark, "distances-text")
    K.write_distances(sssp_tree(spark, sf_dir), path, fmt="text")
    return K.read_distances(spark, path, fmt="text")


def sink_state(spark, sf_dir):
    edges = persist(X.g_tree(_t(spark, sf_dir)))
    state = S.sssp_state(edges, SOURCE)
    path = scratch_path(spark, "state")
    K.write_state(path, G.reset_flags(_dist(state)), edges, M.memo_table(edges, _dist(state)))
    saved, edges, memo = K.read_state(spark, path, with_memo=True)
    return (
        saved.select(F.lit("state").alias("kind"), F.col("v").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("d").alias("x"))
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("x")))
        .unionByName(memo.select(F.lit("memo").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("msg").alias("x")))
    )


# --- streaming -----------------------------------------------------------------------------

def _write_update_files(spark, sf_dir) -> str:
    folder = scratch_path(spark, "update-stream")
    # A batch takes a number of files: no more of them than partitions, however many ranges the events fill.
    text.write_update_text(X.update_stream(_t(spark, sf_dir)).coalesce(num_partitions(spark)), folder)
    return folder


def stream_updates(spark, sf_dir):
    folder = _write_update_files(spark, sf_dir)
    out = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    stream = U.file_update_stream(spark, folder)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a replayed batch replaces its rows

    q = stream.writeStream.foreachBatch(append).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("src", "dst", "weight", "seq")


def stream_sssp(spark, sf_dir):
    edges, _ = _ev(spark, sf_dir, with_updates=False)
    folder = _write_update_files(spark, sf_dir)
    state_path = scratch_path(spark, "stream-state")
    ckpt = scratch_path(spark, "stream-ckpt")
    q, maintainer = U.maintain_distances(
        U.file_update_stream(spark, folder, max_files_per_trigger=2),
        edges,
        state_path,
        ckpt,
        SOURCE,
        trigger={"availableNow": True},
    )
    q.awaitTermination()
    _, _, dist = maintainer.latest(spark)
    return dist.select("v", "d")


QUERIES: dict[str, Query] = {
    "scan_edge_text": scan_edge_text,
    "graph_from_text": graph_from_text,
    "scan_updates": scan_updates,
    "nary_tree": nary_tree,
    "vertices_from_edges": vertices_from_edges,
    "init_state": init_state,
    "merge_vertices": merge_vertices,
    "triplets": triplets,
    "reset_flags": reset_flags,
    "candidate_messages": candidate_messages,
    "aggregate_messages": aggregate_messages,
    "memo_table": memo_table,
    "min_message": min_message,
    "changed_messages": changed_messages,
    "merge_memo": merge_memo,
    "vertex_step": vertex_step,
    "merge_state": merge_state,
    "active_frontier": active_frontier,
    "affected_sources": affected_sources,
    "pregel_min": pregel_min,
    "pregel_memo": pregel_memo,
    "pregel_memo_after_update": pregel_memo_after_update,
    "update_edge": update_edge,
    "update_edge_batch": update_edge_batch,
    "create_edges": create_edges,
    "edge_union_all": edge_union_all,
    "upsert_edges": upsert_edges,
    "sssp": sssp,
    "sssp_tree": sssp_tree,
    "sssp_events": sssp_events,
    "hop_count": hop_count,
    "sssp_after_update": sssp_after_update,
    "sssp_after_insert": sssp_after_insert,
    "hop_distances": hop_distances,
    "last_stage_distance": last_stage_distance,
    "stage_message_counts": stage_message_counts,
    "stage_messages": stage_messages,
    "hop_distances_after_update": hop_distances_after_update,
    "disturbed_vertices": disturbed_vertices,
    "disturbed_flags": disturbed_flags,
    "count_disturbed": count_disturbed,
    "sink_distances": sink_distances,
    "sink_state": sink_state,
    "stream_updates": stream_updates,
    "stream_sssp": stream_sssp,
}

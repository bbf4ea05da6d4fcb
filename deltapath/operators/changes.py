"""Edge changes: weight updates (last write wins), insertions, upserts.

Updates carry an explicit ``seq``: DataFrames have no row order, so "the last
line wins" becomes "the largest ``seq`` wins".  Each change is one join, not
one pass over the edges per update line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import checked_weight, parse_edge_line
from .graph import collapse_parallel, vertices_from_edges


def update_from_text(spark: SparkSession, line: str, seq: int = 0) -> DataFrame:
    """One ``"src dst weight"`` string -> a one-row update ``(src, dst, weight, seq)``."""
    row = spark.range(1).select(F.lit(line).alias("value"))
    return row.select(*parse_edge_line(F.col("value")), F.lit(seq).cast("bigint").alias("seq"))


def latest_updates(updates: DataFrame) -> DataFrame:
    """Last write per edge key by ``seq`` -> ``(src, dst, weight, seq)``.

    ``max_by`` aggregates partially and in a hash table, so a key updated a
    billion times still ships one row per map task.
    """
    if "seq" not in updates.columns:
        updates = updates.withColumn("seq", F.lit(0).cast("bigint"))
    best = updates.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight"), F.max("seq").alias("seq"))
    return best.select("src", "dst", checked_weight(F.col("weight")).alias("weight"), "seq")


def update_edge_batch(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """New weights for existing edges (all parallel copies); unknown keys are ignored."""
    u = latest_updates(updates).select("src", "dst", F.col("weight").alias("new_w"))
    joined = edges.join(u, ["src", "dst"], "left")
    return joined.select("src", "dst", F.coalesce(F.col("new_w"), F.col("weight")).alias("weight"))


def update_edge(edges: DataFrame, update: str | DataFrame) -> DataFrame:
    """Single update, as a ``"src dst weight"`` string or a one-row DataFrame."""
    if isinstance(update, str):
        update = update_from_text(edges.sparkSession, update)
    return update_edge_batch(edges, update)


def unknown_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose edge does not exist (what ``update_edge`` ignores)."""
    return latest_updates(updates).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def edge_union_all(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Bag union of two edge tables (parallel edges kept)."""
    return edges.select("src", "dst", "weight").unionByName(other.select("src", "dst", "weight"))


def create_edges(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Insert edges; a key present on both sides collapses to the smaller weight."""
    return collapse_parallel(edge_union_all(edges, new_edges))


def new_vertices(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    return vertices_from_edges(new_edges).join(vertices_from_edges(edges), "v", "left_anti")


def upsert_edges(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Update existing keys and insert unknown ones in one full outer join."""
    u = latest_updates(updates).select("src", "dst", F.col("weight").alias("new_w"))
    joined = edges.join(u, ["src", "dst"], "full_outer")
    return joined.select("src", "dst", F.coalesce(F.col("new_w"), F.col("weight")).alias("weight"))


def affected_sources(updates: DataFrame, vertices: DataFrame) -> DataFrame:
    """Known vertices that are the source of an updated edge -> ``(v)``."""
    srcs = updates.select(F.col("src").alias("v")).distinct()
    return srcs.join(vertices.select("v"), "v", "left_semi")


def batch_delta(edges: DataFrame, updates: DataFrame, insert: bool) -> DataFrame:
    """Like :func:`edge_delta`, from a batch of updates: only its keys are looked up in ``edges``.

    ``insert``: keys that ``edges`` lacks are new edges (else they are ignored).
    """
    latest = latest_updates(updates).select("src", "dst", F.col("weight").alias("new_w"))
    old = edges.select("src", "dst", F.col("weight").alias("old_w"))
    joined = latest.join(old, ["src", "dst"], "left" if insert else "inner")
    return joined.where(~F.col("old_w").eqNullSafe(F.col("new_w"))).select("src", "dst", "old_w", "new_w")


def edge_delta(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Keys whose weight differs -> ``(src, dst, old_w, new_w)``; NULL = absent on that side."""
    o = old_edges.select("src", "dst", F.col("weight").alias("old_w"))
    n = new_edges.select("src", "dst", F.col("weight").alias("new_w"))
    joined = o.join(n, ["src", "dst"], "full_outer")
    return joined.where(~F.col("old_w").eqNullSafe(F.col("new_w")))

"""Graph construction and vertex state (vertices, initial state, triplets, flags).

A graph is a pair of DataFrames: ``edges(src BIGINT, dst BIGINT, weight DOUBLE)``
and a vertex state ``(v BIGINT, d DOUBLE, ...)`` where ``d`` NULL means
unreachable.  Edges are directed; an undirected graph is given by both
directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import checked_weight
from ..plans.lineage import write_frontier
from .adjacency import Adjacency

EDGE_COLUMNS = ("src", "dst", "weight")


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Project any table onto the edge schema (BIGINT ids, DOUBLE weight)."""
    return df.select(
        F.col(src).cast("bigint").alias("src"),
        F.col(dst).cast("bigint").alias("dst"),
        F.col(weight).cast("double").alias("weight"),
    )


def validate_edges(edges: DataFrame) -> DataFrame:
    """Fail on NULL ids and on NULL / NaN / negative weights."""
    return edges.select(
        F.when(F.col("src").isNull(), F.raise_error(F.lit("edge source id is NULL"))).otherwise(F.col("src")).alias("src"),
        F.when(F.col("dst").isNull(), F.raise_error(F.lit("edge destination id is NULL"))).otherwise(F.col("dst")).alias("dst"),
        checked_weight(F.col("weight")).alias("weight"),
    )


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One row per (src, dst): parallel edges collapse to their smallest weight.

    Partial aggregation combines duplicates map-side, so a key repeated a
    billion times still ships one row per map task.
    """
    return edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def prepare_edges(edges: DataFrame, validate: bool = True, collapse: bool = True) -> DataFrame:
    out = edges.select(*EDGE_COLUMNS)
    if validate:
        out = validate_edges(out)
    if collapse:
        out = collapse_parallel(out)
    return out


def vertices_from_edges(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of all edges -> ``(v)``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def with_source(vertices: DataFrame, source: int) -> DataFrame:
    """Vertex set plus the source (which may have no edges at all)."""
    spark = vertices.sparkSession
    src = spark.range(1).select(F.lit(source).cast("bigint").alias("v"))
    return vertices.select("v").unionByName(src).distinct()


def init_state(vertices: DataFrame, source: int = 0) -> DataFrame:
    """Initial distances: 0.0 at the source, NULL (unreachable) elsewhere."""
    return with_source(vertices, source).select(
        "v", F.when(F.col("v") == F.lit(source), F.lit(0.0)).alias("d")
    )


def merge_vertices(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Vertex set of ``edges`` with known vertices keeping their state, new ones NULL."""
    return vertices_from_edges(edges).join(state, "v", "left")


def reset_flags(state: DataFrame) -> DataFrame:
    """Clear the per-run ``disturbed`` flag, keep distances."""
    return state.withColumn("disturbed", F.lit(0))


def distances(state: DataFrame) -> DataFrame:
    return state.select("v", "d")


def triplets(edges: DataFrame | Adjacency, state: DataFrame) -> DataFrame:
    """Each edge with the state of both endpoints: ``src, dst, weight, src_d, dst_d``.

    ``state`` holds every vertex, so both joins keep every edge.  Edges that
    are laid out are not shuffled for their sources.
    """
    if isinstance(edges, Adjacency):
        ends, n = write_frontier(state.select("v", "d"), "ends")
        rows = edges.expand(ends.select(F.col("v").alias("src"), F.col("d").alias("src_d")), n)
        t = ends.select(F.col("v").alias("dst"), F.col("d").alias("dst_d"))
        # Hashing the ends spares a sort of the edges.
        t = F.broadcast(t) if n <= edges.broadcast_rows else t.hint("shuffle_hash")
        return rows.join(t, "dst", "left").select("src", "dst", "weight", "src_d", "dst_d")
    s = state.select(F.col("v").alias("src"), F.col("d").alias("src_d"))
    t = state.select(F.col("v").alias("dst"), F.col("d").alias("dst_d"))
    return edges.join(s, "src", "left").join(t, "dst", "left").select(
        "src", "dst", "weight", "src_d", "dst_d"
    )

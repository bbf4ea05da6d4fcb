"""deltapath: shortest distances over large, changing, weighted directed graphs on Spark.

Graphs are DataFrames ``edges(src, dst, weight)``; results are DataFrames
``(v, d)`` with NULL for unreachable vertices.  See README for the operator map.
"""

from .operators.graph import (
    collapse_parallel,
    init_state,
    merge_vertices,
    prepare_edges,
    reset_flags,
    triplets,
    vertices_from_edges,
)
from .plans.sssp import hop_count, sssp, sssp_state
from .session import checkpoint_dir, local_session

__all__ = [
    "checkpoint_dir",
    "collapse_parallel",
    "hop_count",
    "init_state",
    "local_session",
    "merge_vertices",
    "prepare_edges",
    "reset_flags",
    "sssp",
    "sssp_state",
    "triplets",
    "vertices_from_edges",
]

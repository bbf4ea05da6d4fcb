"""Print the physical plan of one relaxation round (what the README's scale notes refer to).

Usage: python tools/explain_round.py [sf_dir] [broadcast|salted]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from deltapath.operators.adjacency import Adjacency  # noqa: E402
from deltapath.operators.graph import prepare_edges, vertices_from_edges  # noqa: E402
from deltapath.plans import sssp as S  # noqa: E402
from deltapath.plans.lineage import cut, write_frontier  # noqa: E402
from deltapath.session import local_session  # noqa: E402
from deltapath.sources import Tables, g_ps  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    mode = sys.argv[2] if len(sys.argv) > 2 else "broadcast"
    spark = local_session()
    bound = 0 if mode == "salted" else 1_000_000
    adj = Adjacency.build(prepare_edges(g_ps(Tables(spark, sf_dir))), "src", "dst", None, bound, 1)
    dist = cut(S.initial_dist(vertices_from_edges(adj.base), 0, adj.partitions))
    frontier, rows = write_frontier(S.frontier_of(dist).select(F.col("v").alias("src"), "d"))
    nxt = S.apply_candidates(dist, S.best_candidates(adj.expand(frontier, rows)))
    nxt.explain("formatted")


if __name__ == "__main__":
    main()

"""Hot keys: a hub holding a large share of the edges is salted, results unchanged."""

from pyspark.sql import functions as F

from conftest import as_dict
from deltapath.operators.adjacency import Adjacency
from deltapath.plans import pregel as P
from deltapath.plans import sssp as S
from deltapath.operators import graph as G


def hub_graph(spark):
    # vertex 1 is a hub with a third of all edges; the graph is three levels deep
    hub = spark.range(2, 3002).select(F.lit(1).cast("bigint").alias("src"), F.col("id").alias("dst"), (F.col("id") % 5 + 1).cast("double").alias("weight"))
    kids = spark.range(0, 6000).select(
        (F.col("id") % 3000 + 2).alias("src"), (F.col("id") + 100000).alias("dst"), (F.col("id") % 3 + 1).cast("double").alias("weight")
    )
    chain = kids
    root = spark.range(1).select(F.lit(0).cast("bigint").alias("src"), F.lit(1).cast("bigint").alias("dst"), F.lit(1.0).alias("weight"))
    return root.unionByName(hub).unionByName(chain)


def test_salted_layout_matches_broadcast(spark):
    e = hub_graph(spark)
    plain = as_dict(S.sssp(e, 0))
    salted = as_dict(S.sssp(e, 0, broadcast_rows=0, min_hot_rows=100))
    assert plain == salted


def test_hot_key_table_is_bounded(spark):
    e = G.prepare_edges(hub_graph(spark))
    adj = Adjacency.build(e, "src", "dst", partitions=8, broadcast_rows=0, min_hot_rows=100)
    frontier = spark.createDataFrame([(1, 0.0)], "src bigint, d double")
    got = adj.expand(frontier, 10**9).count()
    hot = adj._hot.collect()
    assert got == 3000
    assert len(hot) < adj.partitions
    assert [r["src"] for r in hot] == [1] and hot[0]["n_salt"] > 1
    adj.release()


def test_pregel_with_salting(spark):
    e = hub_graph(spark)
    init = G.init_state(G.vertices_from_edges(e), 0).withColumnRenamed("d", "value")
    got = as_dict(P.pregel(e, init, broadcast_rows=0, min_hot_rows=100), value="value")
    assert got == as_dict(S.sssp(e, 0))


def test_pregel_generic_reachability(spark, edges):
    e = edges([(0, 1, 3), (1, 2, 4), (5, 6, 1), (2, 0, 1)])
    init = spark.createDataFrame([(v, 1.0 if v == 0 else None) for v in (0, 1, 2, 5, 6)], "v bigint, value double")
    got = as_dict(
        P.pregel(e, init, send=lambda value, weight: value, reduce=F.max, update=lambda old, msg: F.greatest(old, msg)),
        value="value",
    )
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 5: None, 6: None}

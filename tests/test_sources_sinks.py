"""Text sources, generated trees, sinks."""

import pytest
from pyspark.sql import functions as F

from deltapath.operators import changes as C
from deltapath.operators import sinks as K
from deltapath.plans import incremental as I
from deltapath.plans import sssp as S
from deltapath.session import scratch_path
from deltapath.sources import generators, text
from deltapath.streaming.updates import parse_kafka_rows


def test_edge_text_roundtrip_and_extra_tokens(spark):
    path = scratch_path(spark, "t-edges")
    spark.createDataFrame([("0 1 2.5 extra",), ("1 2 3",)], "value string").write.text(path)
    rows = sorted(map(tuple, text.read_edge_text(spark, path).collect()))
    assert rows == [(0, 1, 2.5), (1, 2, 3.0)]


@pytest.mark.parametrize("line", ["0 1", "0 x 1", "0  1 2"])
def test_malformed_line_fails_in_strict_mode(spark, line):
    path = scratch_path(spark, "t-bad")
    spark.createDataFrame([(line,)], "value string").write.text(path)
    with pytest.raises(Exception, match="malformed edge line"):
        text.read_edge_text(spark, path).collect()
    lenient = text.read_edge_text(spark, path, strict=False).collect()
    assert len(lenient) == 1


def test_kafka_rows(spark):
    lines = [(b"0 1 2.5", 0, 7), (b"0 1 3.5 99", 1, 2), (b"not an update", 0, 8), (None, 0, 9), (b"0 1 -2 5", 0, 10), (b"0 1 NaN 5", 0, 11)]
    raw = spark.createDataFrame([(v and bytearray(v), p, o) for v, p, o in lines], "value binary, partition int, offset bigint")
    good, bad = parse_kafka_rows(raw)
    assert sorted(map(tuple, good.collect())) == [(0, 1, 2.5, 7), (0, 1, 3.5, (1 << 40) + 2)]
    assert sorted((r.offset, r.value) for r in bad.collect()) == [(8, "not an update"), (9, None), (10, "0 1 -2 5"), (11, "0 1 NaN 5")]
    good, bad = parse_kafka_rows(raw, explicit_seq=True)
    assert list(map(tuple, good.collect())) == [(0, 1, 3.5, 99)]
    assert good.count() + bad.count() == len(lines)


def test_single_update_as_a_string(edges):
    got = sorted(map(tuple, C.update_edge(edges([(0, 1, 5), (1, 2, 1)]), "0 1 2.5").collect()))
    assert got == [(0, 1, 2.5), (1, 2, 1.0)]


def test_resume_from_a_saved_state(spark, edges, updates):
    path = scratch_path(spark, "t-state")
    e = edges([(0, 1, 5), (1, 2, 1)])
    K.write_state(path, S.sssp_state(e, 0), e)
    state, saved = K.read_state(spark, path)
    _, new = I.sssp_after_upsert(state, saved, updates([(0, 1, 2, 1), (2, 3, 4, 2)]), 0)
    assert {r.v: r.d for r in new.collect()} == {0: 0.0, 1: 2.0, 2: 3.0, 3: 7.0}


def test_update_text_keeps_seq(spark):
    path = scratch_path(spark, "t-upd")
    u = spark.createDataFrame([(0, 1, 2.0, 5)], "src bigint, dst bigint, weight double, seq bigint")
    text.write_update_text(u, path)
    assert [tuple(r) for r in text.read_update_text(spark, path).collect()] == [(0, 1, 2.0, 5)]


def test_nary_tree_closed_form(spark):
    t = generators.nary_tree(spark, 1000, 3)
    row = t.agg(F.count("*").alias("n"), F.sum("src").alias("s")).first()
    assert (row["n"], row["s"]) == (999, 165834)
    assert generators.nary_tree(spark, 1, 3).count() == 0
    assert generators.nary_tree(spark, 10, 0).count() == 0
    five = sorted(map(tuple, generators.nary_tree(spark, 5, 2).select("src", "dst").collect()))
    assert five == [(0, 1), (0, 2), (1, 3), (1, 4)]


def test_distance_text_sink_roundtrip(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 2.5), (2, None)], "v bigint, d double")
    path = scratch_path(spark, "t-dist")
    K.write_distances(d, path, fmt="text")
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert lines == ["(0,0.0)", "(1,2.5)", "(2,Infinity)"]
    back = sorted(map(tuple, K.read_distances(spark, path, fmt="text").collect()), key=lambda t: t[0])
    assert back == [(0, 0.0), (1, 2.5), (2, None)]

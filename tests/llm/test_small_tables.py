"""Small tables are written by few tasks, however many partitions a shuffle has."""

import uuid
from contextlib import contextmanager

from llm_rows import SCHEMA, prose

from deltapath.llm import shingle_join
from deltapath.llm.common import ROWS_PER_TASK, sized
from deltapath.llm.graph import components

PARTITIONS = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@contextmanager
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in PARTITIONS}
    try:
        for k, v in PARTITIONS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tasks_of(spark, job):
    """What ``job`` returns, and how many tasks it ran."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "test")
    try:
        out = job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_rounds_of_few_links_have_few_tasks(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    with many_partitions(spark):
        links = spark.createDataFrame(chain, "u long, v long").coalesce(1)
        got, tasks = tasks_of(spark, lambda: {r["node"]: r["component"] for r in components(links).collect()})
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert tasks < 6 * 64  # every round had four tables of 64 tasks


def test_join_of_few_texts_has_few_tasks(spark):
    texts = [prose(s, 120) for s in range(6)]
    rows = [(10 * s + k, t + " more" * k, "en", "a", 1, 0.5, 7, 3, "row", 1) for s, t in enumerate(texts) for k in range(4)]
    with many_partitions(spark):
        docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        got, tasks = tasks_of(spark, lambda: {r["doc_id"]: r["component_id"] for r in shingle_join.components_of(docs).collect()})
    assert got == {r[0]: r[0] // 10 * 10 for r in rows}
    assert tasks < 20 * 64


def test_large_tables_keep_their_partitions(spark):
    rows = spark.range(0, 1000, 1, 16)
    assert sized(rows, 20 * ROWS_PER_TASK).rdd.getNumPartitions() == 16
    assert sized(rows, 3 * ROWS_PER_TASK + 1).rdd.getNumPartitions() == 4
    assert sized(rows, 0).rdd.getNumPartitions() == 1

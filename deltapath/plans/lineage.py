"""Lineage control for driver-side loops.

Every generation of loop state is persisted (MEMORY_AND_DISK) so the next
round reads it once; every ``interval`` rounds it is written with a reliable
``checkpoint`` into the shared checkpoint folder, which bounds how far a lost
executor has to recompute.  ``localCheckpoint`` is never used: its blocks die
with the executor that holds them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager, nullcontext

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

_AQE = "spark.sql.adaptive.enabled"
#: The shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that are dealt out by some columns of a join's key are not shuffled for the others.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_CODEC = "spark.sql.parquet.compression.codec"


@contextmanager
def _held(spark: SparkSession, **settings: str):
    """``settings`` (dots as in ``{"a.b": "c"}``) for a while, then what was there before."""
    prev = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in prev.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def on_buckets(spark: SparkSession):
    """For loops over large tables: queries leave no shuffle files behind, joins shuffle no rows that buckets deal out, tables are written small."""
    return _held(spark, **{_CLEAN: "true", _ALL_KEYS: "false", _CODEC: "zstd"})


@contextmanager
def static_plan(spark: SparkSession):
    """Plan with adaptive execution off, so the output partitioning is known.

    An adaptive plan reports its partitioning as unknown until it has run, so
    a cached or checkpointed loop state planned adaptively loses its
    hash-partitioning and would be re-shuffled by every later join.  Loop
    states are planned statically (their joins use explicit strategies:
    count-checked broadcasts and salted shuffled hash joins); the setting is
    restored right after planning.
    """
    with _held(spark, **{_AQE: "false"}):
        yield


def persist(df: DataFrame) -> DataFrame:
    with static_plan(df.sparkSession):
        return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once and cut its lineage with a reliable checkpoint.

    The frame is persisted first so the checkpoint write reads the cached
    blocks instead of recomputing the plan.  The returned frame keeps the
    output partitioning of ``df`` (Spark records it on the checkpointed RDD),
    so later co-partitioned joins still avoid a shuffle.
    """
    checkpoint_dir(df.sparkSession)
    cached = persist(df)
    with static_plan(df.sparkSession):
        out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    # Keep a cached copy of the checkpointed rows so later rounds do not
    # re-read the files; the files stay as the recovery point.
    return persist(out)


class Generations:
    """Keep the two newest generations of a loop value; release older ones."""

    def __init__(self) -> None:
        self._held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df)
        while len(self._held) > 3:
            self._held.pop(0).unpersist(blocking=False)
        return df

    def release(self) -> None:
        for df in self._held:
            df.unpersist(blocking=False)
        self._held.clear()

    def release_except(self, keep: DataFrame) -> None:
        for df in self._held:
            if df is not keep:
                df.unpersist(blocking=False)
        self._held.clear()


def write_table(df: DataFrame, name: str, static: bool = False, only: Column | None = None) -> tuple[str, int]:
    """Write ``df`` as parquet to a new folder of the shared checkpoint folder: its path and row count (``only``: of these rows)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # The row count is observed on the write itself: no extra job.
    seen = Observation(name)
    with static_plan(spark) if static else nullcontext():
        df.observe(seen, (F.count(F.lit(1)) if only is None else F.count_if(only)).alias("rows")).write.parquet(path)
    return path, int(seen.get["rows"])


def write_frontier(df: DataFrame, name: str = "frontier", static: bool = False) -> tuple[DataFrame, int]:
    """Write a loop frontier as a parquet table in the shared folder; read it back.

    The read-back table is a new leaf: a round's join then never sees the loop
    state on both sides (a self-join, which Spark resolves by re-instancing one
    side and so bypasses its cache and recomputes its lineage).  Writing it is
    also the job that materialises the new loop state.  Returns the table and
    its row count.  ``static``: plan without adaptive execution, for joins that
    must use the known partitioning of a cached table.
    """
    path, rows = write_table(df, name, static)
    # With the schema given, reading needs no job of its own.
    return df.sparkSession.read.schema(df.schema).parquet(path), rows


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_buckets(df: DataFrame, name: str, n: int, keys: list[str], order: list[str], only: Column | None = None) -> tuple[DataFrame, str, int, int]:
    """Write ``df``, dealt out into ``n`` partitions by ``keys``, as a bucketed parquet table in the shared folder.

    Returns the table, which joins and groups by ``keys`` without a shuffle,
    its path, its row count and that of the rows ``only``.  Rows of a file are
    sorted by ``order``, which keeps it small.  Spark reads buckets of tables
    with a name only, so it has one until it is looked up; the files stay.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"deltapath_{uuid.uuid4().hex}"
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(True) if only is None else only).alias("some")]
    with static_plan(spark):
        df.observe(seen, *counts).write.option("path", path).bucketBy(n, *keys).sortBy(*order).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out, path, int(seen.get["rows"]), int(seen.get["some"])

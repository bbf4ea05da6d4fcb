"""Writing results: distances, full state, disturbed vertices.

Parquet is the default (columnar, typed, readable back with pushdown); the
text form keeps the ``(vid,dist)`` tuple lines of the original output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import distance_text


def write_distances(dist: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "text":
        dist.select(distance_text(F.col("v"), F.col("d")).alias("value")).write.mode(mode).text(path)
    else:
        dist.select("v", "d").write.mode(mode).format(fmt).save(path)


def read_distances(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt != "text":
        return spark.read.format(fmt).load(path).select("v", "d")
    raw = spark.read.text(path).select(F.regexp_extract("value", r"^\((-?\d+),(.*)\)$", 1).alias("v"),
                                        F.regexp_extract("value", r"^\((-?\d+),(.*)\)$", 2).alias("d"))
    return raw.select(
        F.col("v").cast("bigint").alias("v"),
        F.when(F.col("d") == F.lit("Infinity"), F.lit(None).cast("double")).otherwise(F.col("d").cast("double")).alias("d"),
    )


def write_state(path: str, state: DataFrame, edges: DataFrame, memo: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Vertex state, edges and (optionally) memo rows as parquet under ``path``.

    This is also the saved state an incremental update starts from.
    """
    state.write.mode(mode).parquet(f"{path}/state")
    edges.select("src", "dst", "weight").write.mode(mode).parquet(f"{path}/edges")
    if memo is not None:
        memo.write.mode(mode).parquet(f"{path}/memo")


def read_state(spark: SparkSession, path: str, with_memo: bool = False) -> tuple[DataFrame, ...]:
    state = spark.read.parquet(f"{path}/state")
    edges = spark.read.parquet(f"{path}/edges")
    if with_memo:
        return state, edges, spark.read.parquet(f"{path}/memo")
    return state, edges


def write_disturbed(disturbed: DataFrame, path: str, mode: str = "overwrite") -> None:
    disturbed.select("v").write.mode(mode).parquet(path)

"""Edge lists and update batches as text: one ``"src dst weight [seq]"`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import edge_text, parse_edge_line


def parse_edges(lines: DataFrame, strict: bool = True, column: str = "value") -> DataFrame:
    """Text rows -> ``(src, dst, weight)``; tokens past the third are ignored."""
    return lines.select(*parse_edge_line(F.col(column), strict=strict))


def parse_updates(lines: DataFrame, strict: bool = True, column: str = "value") -> DataFrame:
    """Text rows -> ``(src, dst, weight, seq)``; ``seq`` orders updates (last wins)."""
    return lines.select(*parse_edge_line(F.col(column), strict=strict, with_seq=True))


def read_edge_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_edges(spark.read.text(path), strict)


def read_update_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_updates(spark.read.text(path), strict)


def write_edge_text(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    edges.select(edge_text(F.col("src"), F.col("dst"), F.col("weight")).alias("value")).write.mode(mode).text(path)


def write_update_text(updates: DataFrame, path: str, mode: str = "overwrite") -> None:
    line = F.concat_ws(" ", edge_text(F.col("src"), F.col("dst"), F.col("weight")), F.col("seq").cast("string"))
    updates.select(line.alias("value")).write.mode(mode).text(path)

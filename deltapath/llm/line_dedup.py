"""Boilerplate lines by their spread over sites.

A line is known by a 64-bit hash.  HyperLogLog sketches of the sites on which
a line stands are built in every task and merged by the aggregation, so a line
that is on every page costs one sketch per task.  Lines whose estimate is
clearly below or above the threshold are decided by it; for the band between,
sites are counted exactly.  Lines on ``min_sites`` sites or more are removed
from all texts.

A site is ``source``; a null source is a site of its own.  Lines are the parts
between line feeds; lines without a word are never removed.  Null and empty
texts have no lines and stay as they are (null counts as empty).  A row that
repeats a ``doc_id`` is cleaned on its own.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .common import WS_CLASS

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 6
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over five standard errors of the sketch.
BAND = 0.1
#: Hashes (8 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike(f"[^{WS_CLASS}]")


def line_rows(docs: DataFrame) -> DataFrame:
    """(h, site) of every line with a word."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("")).alias("site"),
        F.explode(F.filter(lines_of(F.coalesce(docs["text"], F.lit(""))), has_word)).alias("line"),
    )
    return rows.select(F.xxhash64("line").alias("h"), "site")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """(h, sites, counted) of the lines on ``min_sites`` sites or more, and their number.

    ``sites`` is the estimate, or the exact count where ``counted``.
    """
    rows = line_rows(docs)
    sketched = rows.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = sketched.select("h", F.hll_sketch_estimate("sketch").alias("estimate"))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    candidates, n = write_frontier(spread.where(F.col("estimate") >= F.lit(low)), "spread")
    near = candidates.where(F.col("estimate") <= F.lit(high)).select("h")
    n_near = near.count() if n else 0
    sites = rows.join(bounded(near, n_near), "h", "left_semi").distinct()
    exact = sites.groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    sure = candidates.where(F.col("estimate") > F.lit(high)).select("h", F.col("estimate").alias("sites"), F.lit(False).alias("counted"))
    return write_frontier(sure.unionByName(exact.select("h", "sites", F.lit(True).alias("counted"))), "boilerplate")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``docs``, all columns, ``text`` without boilerplate lines, and the struct ``__lines`` (n_lines, n_removed).

    The places of boilerplate lines are gathered by row: a join of line hashes
    with the table of boilerplate lines, which is broadcast if its counted
    size allows, then one list per row that has such lines.
    """
    found, n = boilerplate(docs, min_sites)
    names = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("__id"), F.xxhash64(text).alias("__print")]
    # Rows that share doc_id and text share the places too.
    lines = docs.select(*key, F.posexplode(lines_of(text)).alias("__at", "__line")).where(has_word(F.col("__line")))
    hits = lines.select("__id", "__print", "__at", F.xxhash64("__line").alias("__h")).join(bounded(found.select(F.col("h").alias("__h")), n), "__h", "left_semi")
    places = hits.groupBy("__id", "__print").agg(F.collect_set("__at").alias("__gone"))
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), text.alias("__text"), *key)
    joined = rows.join(places, ["__id", "__print"], "left").withColumn("__all", lines_of(F.col("__text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__gone"))
    joined = joined.withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    left = F.when(F.col("__stay").isNull(), F.col("__text")).otherwise(F.array_join(F.transform("__stay", lambda i: F.col("__all")[i]), "\n"))
    n_lines = F.when(F.col("__text") == "", 0).otherwise(F.size("__all")).cast("long")
    n_removed = F.when(F.col("__stay").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return joined.select(
        *[(left if c == "text" else F.col("__row").getField(c)).alias(c) for c in names],
        F.struct(n_lines.alias("n_lines"), n_removed.alias("n_removed")).alias("__lines"),
    )


def cleaned_digests(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars, text_sha256) of the cleaned texts."""
    rows = cleaned(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["source"]), min_sites)
    return rows.select("doc_id", "__lines.n_lines", "__lines.n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))

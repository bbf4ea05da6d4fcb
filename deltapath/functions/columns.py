"""Column expressions shared by the sources, operators and sinks.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage code generation; no Python UDF is involved anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the edge text format: tokens are separated by one space,
# positions 0, 1, 2 are source id, destination id and weight; extra tokens are
# ignored.  Distances of unreachable vertices are NULL (the sentinel of the
# original text form is the largest double).
EDGE_TOKEN_SEPARATOR = " "
EDGE_TEXT_FORMAT = "%d %d %s"
DISTANCE_TEXT_FORMAT = "(%d,%s)"


def _checked(value: Column, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def edge_tokens(line: Column) -> Column:
    return F.split(line, EDGE_TOKEN_SEPARATOR)


def token(tokens: Column, position: int, to_type: str, strict: bool = True, what: str = "token") -> Column:
    """Token ``position`` (0-based) of a split line cast to ``to_type``.

    strict: a missing or unparsable token fails the job, as a malformed line
    does in the original program; otherwise it becomes NULL.
    """
    raw = F.try_element_at(tokens, F.lit(position + 1))
    value = raw.try_cast(to_type)
    if strict:
        return _checked(value, f"malformed edge line: bad {what}")
    return value


def parse_edge_line(line: Column, strict: bool = True, with_seq: bool = False) -> list[Column]:
    """``"src dst weight [seq]"`` -> src BIGINT, dst BIGINT, weight DOUBLE [, seq BIGINT]."""
    toks = edge_tokens(line)
    cols = [
        token(toks, 0, "bigint", strict, "source id").alias("src"),
        token(toks, 1, "bigint", strict, "destination id").alias("dst"),
        token(toks, 2, "double", strict, "weight").alias("weight"),
    ]
    if with_seq:
        cols.append(token(toks, 3, "bigint", strict, "sequence number").alias("seq"))
    return cols


def checked_weight(weight: Column) -> Column:
    """Reject NULL, NaN and negative weights: relaxation never settles on them."""
    bad = weight.isNull() | F.isnan(weight) | (weight < F.lit(0.0))
    return F.when(bad, F.raise_error(F.lit("edge weight must be a non-negative number"))).otherwise(weight)


def edge_text(src: Column, dst: Column, weight: Column) -> Column:
    return F.format_string(EDGE_TEXT_FORMAT, src, dst, weight.cast("string"))


def distance_text(v: Column, d: Column) -> Column:
    return F.format_string(DISTANCE_TEXT_FORMAT, v, F.coalesce(d.cast("string"), F.lit("Infinity")))


def message(sender_distance: Column, weight: Column) -> Column:
    """The message a reached sender puts on an edge: its distance plus the weight."""
    return sender_distance + weight


def best_message(msg: Column, sender: Column) -> tuple[Column, Column]:
    """Aggregates: smallest message and a sender that sent it.

    ``min`` and ``min_by`` have fixed-width buffers, so Spark uses a hash
    aggregate with a map-side partial step (a ``min`` over a struct would
    force a sort-based aggregate).
    """
    return F.min(msg).alias("d"), F.min_by(sender, msg).alias("parent")

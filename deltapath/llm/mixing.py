"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words (``targets``).  A target is met by complete
epochs first: every document is taken ``floor(target / source size)`` times.
The rest is a weighted sample without replacement: a document's key is an
exponential variable divided by its quality weight, and documents are taken in
ascending order of key until their sizes sum up to the rest.  The document at
the boundary is taken if that brings the source nearer to its target.

The prefix sum needs no sort of a source: a histogram of sizes over the key's
leading digits, summed before the shuffle, tells the one bin of each source in
which the boundary lies; bins are cut further until the boundary's bin holds a
few thousand documents, and only those are ordered.  A source that holds a
third of all rows thus costs what its histogram costs.

Null texts have size 0; documents of size 0 take nothing.  A null source is a
source of its own, last in the order.  Rows that repeat a ``doc_id`` have
equal keys and are ordered by size; equal ones are interchangeable.  Empty
tables give empty results.  Keys come from ``doc_id`` and a seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
SEED = 17
LEAST_WEIGHT = 0.1
CELL_BITS = 50
BIN_BITS = 10
#: A bin of up to so many documents is cut no further.
SMALL_BIN = 5_000
SOURCE_ROWS = 200_000


def quality_weight(text: Column) -> Column:
    """A document's weight in (0, 1]: less for texts with many symbols or many upper-case letters."""
    letters = F.greatest(F.char_length(text), F.lit(1))
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>{}\[\]~^=_\\]+", ""))
    upper = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * symbols / letters - upper / letters)


def with_measures(docs: DataFrame, seed: int, *keep: Column) -> DataFrame:
    """``keep`` and (doc_id, source, size, key, cell).

    The key is exponential with the document's weight as its rate; the cell is
    its place in [0, 2**CELL_BITS) by the distribution function at the least
    weight, so that cells are in the order of keys and none is crowded.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    id_ = docs["doc_id"].cast("long")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_, F.lit(-1)), id_.isNull()), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select(
        *keep,
        id_.alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        (-F.log(uniform) / quality_weight(text)).alias("key"),
    )
    cells = 1 << CELL_BITS
    return rows.withColumn("cell", F.least(F.lit(cells - 1), F.floor(-F.expm1(-LEAST_WEIGHT * F.col("key")) * cells)).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Words each source shall give: ``share`` of all words by weight, no source above ``limit`` times its size.

    Sources are ordered by code point, null last; weights repeat in that
    order.  What exceeds a limit goes to the other sources by weight, until
    none is above its limit (or all are at it).
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: limit * n for s, n in order}
    left, free, out = share * sum(n for _, n in order), dict(weight), {}
    while free:
        total = sum(free.values())
        over = [s for s, w in free.items() if left * w / total > cap[s]]
        if not over:
            return out | {s: left * w / total for s, w in free.items()}
        for s in over:
            out[s] = cap[s]
            del free[s]
        left = max(0.0, left - sum(cap[s] for s in over))
    return out


def _plan(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> tuple[list[tuple], str]:
    """A row per source: its size, target, complete epochs, the rest, the cells [lo, hi) in which the prefix sum
    of sizes reaches the rest, and what the cells below them sum up to."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"))
    per_source = [(r["source"], int(r["n"])) for r in totals.collect()]  # one row per source
    goal = targets(per_source, weights, share, limit)
    size = dict(per_source)
    epochs = {s: int(goal[s] / n + 1e-12) if n else 0 for s, n in per_source}
    rest = {s: max(0.0, goal[s] - epochs[s] * n) for s, n in per_source}
    at = {s: (0, 1 << CELL_BITS, 0) for s in size}
    open_, width = {s for s in size if rest[s] > 0}, CELL_BITS
    while open_ and width >= BIN_BITS:
        width -= BIN_BITS
        search = sizes.sparkSession.createDataFrame([(s, *at[s], rest[s]) for s in sorted(open_, key=str)], "source string, lo long, hi long, below long, rest double")
        inside = with_source(sizes.where("size > 0"), search, len(open_)).where("cell >= lo and cell < hi")
        bins = inside.groupBy("source", "lo", "below", "rest", F.expr(f"shiftright(cell - lo, {width})").alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0)))  # up to 2**BIN_BITS rows a source
        crossed = {r["source"]: r for r in bins.where("before < rest and rest <= before + words").collect()}
        for s in list(open_):
            r = crossed.get(s)
            if r is None:  # nothing reaches the rest, by rounding: all cells lie below it
                at[s] = (1 << CELL_BITS, 1 << CELL_BITS, size[s])
            else:
                lo = at[s][0] + (r["bin"] << width)
                at[s] = (lo, lo + (1 << width), r["before"])
            if r is None or r["rows"] <= SMALL_BIN:
                open_.discard(s)
    return [(s, n, float(goal[s]), epochs[s], rest[s], *at[s]) for s, n in per_source], "source string, source_size long, target double, epochs int, rest double, lo long, hi long, below long"


def with_source(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Rows with their source's columns; the table has ``n`` rows, one per source, and is broadcast while these are few."""
    small = table.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(small) if n <= SOURCE_ROWS else small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _copies(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
    """Rows of ``with_measures`` with their source's plan and ``copies``, how often each is taken."""
    rows = with_source(rows, rows.sparkSession.createDataFrame(plan, schema), len(plan))
    partly = (F.col("rest") > 0) & (F.col("size") > 0)
    boundary = partly & (F.col("cell") >= F.col("lo")) & (F.col("cell") < F.col("hi"))
    sure = rows.where(~boundary).withColumn("__once", partly & (F.col("cell") < F.col("lo")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(boundary).withColumn("__before", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # The boundary's document counts if half of it lies within the rest.
    edge = edge.withColumn("__once", F.col("__before") + F.col("size") / 2 <= F.col("rest")).drop("__before")
    return sure.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("__once").cast("int")).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies): ``copies`` times the document makes ``taken`` words."""
    sizes = written(with_measures(docs, seed), "sizes")
    chosen = _copies(sizes, *_plan(sizes, weights, share, limit))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    The decision depends on a row and its source's plan alone, so it is made
    on the rows where they are; only the boundary cells' rows are shuffled.
    """
    names = docs.columns
    plan, schema = _plan(written(with_measures(docs, seed), "sizes"), weights, share, limit)
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), docs["doc_id"], docs["source"], docs["text"])
    chosen = _copies(with_measures(wide, seed, wide["__row"]), plan, schema).where("copies > 0")
    taken = chosen.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("__n"))
    return taken.select(*[F.col("__row").getField(c).alias(c) for c in names])

"""Message passing with a memory on every edge: only messages that differ from the last one are sent.

A vertex has any number of value columns.  Each receiver remembers the last
message of each in-neighbour, as rows ``(dst, src, msg)``; what a vertex
computes with is an aggregate over all messages that it remembers, not only
over those of the round.  So a value may rise again, and a run that starts
from a remembered state sends along changed edges only.  The caller gives

* ``send(src, dst, weight, last)``: the message on an edge, NULL for none.
  ``src(name)`` and ``dst(name)`` are value columns of the two ends, ``last``
  is the message that the receiver remembers from this sender;
* ``digest(msg)``: an aggregate that Spark can combine map-side;
* ``update(own, digest, got)``: the new value columns by name; ``own(name)``
  are the present ones, ``own("v")`` is the vertex, ``got`` tells receivers of
  this round;
* ``initial``: a digest that all vertices take before the first round.

A round looks at the out-edges of vertices whose watched columns changed.  The
edges stay in an :class:`Adjacency`; the memory is a base table in buckets by
the receiver, with a receiver of very many in-edges spread over several, and a
log of small tables, one per round, which is merged into the base when it has
grown to a share of it.  A round whose offers are many (their number is the sum
of the senders' out-degrees, known beforehand) joins them to the base where it
lies and writes the next base in the same pass: only the offers are shuffled.
Messages of a receiver are combined before they are shuffled to it.

State and memory are read from written tables, so each round is a recovery
point.  Tables of earlier rounds and shuffle files are deleted as soon as the
next ones are written; what another run has returned is never deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import message
from ..operators.adjacency import DEFAULT_BROADCAST_ROWS, DEFAULT_MIN_HOT_ROWS, Adjacency, bucket_count, hot_keys, with_slot
from ..operators.graph import prepare_edges
from ..session import num_partitions
from .lineage import delete_table, on_buckets, write_buckets, write_frontier, write_table
from .pregel import NotConverged
from .sssp import RunStats

Values = Callable[[str], Column]
#: The log is merged into the base beyond this share of it, or this many tables.
MERGE_SHARE, MERGE_TABLES = 0.25, 12


def _paths(table: DataFrame) -> list[str]:
    """Folders of the files of a written table."""
    return sorted({unquote(f).rsplit("/", 1)[0] for f in table.inputFiles()})


@dataclass
class Memory:
    """Last messages ``(dst, src, msg)``: a base, and later tables that win over it; a NULL message is forgotten."""

    partitions: int
    broadcast_rows: int
    #: Rows (slot, dst, src, msg, sent) in buckets by slot; ``sent``: told in the round that wrote them.
    base: DataFrame | None = None
    base_rows: int = 0
    log: list[tuple[DataFrame, int]] = field(default_factory=list)
    #: Age of the next table of the log; a table that :meth:`aged` has marked is read together with its like.
    age: int = 0
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS
    #: Buckets of the base, and receivers that are spread over several.
    buckets: int = 0
    hot: tuple[DataFrame, int] | None = None
    #: Written tables that nobody else can read, and those of them that are merged, which :meth:`sweep` deletes.
    private: set[str] = field(default_factory=set)
    merged: set[str] = field(default_factory=set)

    def prepare(self, edges: Adjacency) -> None:
        """Buckets for as many messages as there are edges; from now on, what is there already is not deleted."""
        self.private, self.merged = set(), set()
        rows = edges.rows + edges.n_changes
        if self.base is not None and bucket_count(rows, self.partitions) <= 2 * self.buckets:
            return
        if self.base is not None:
            self.log.insert(0, (self.base.select("dst", "src", "msg"), self.base_rows))
            self.base, self.base_rows = None, 0
        self.buckets = bucket_count(rows, self.partitions)
        self.hot = self._hot(edges.edges(), rows)

    def _hot(self, rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        threshold = max(-(-n // self.buckets), self.min_hot_rows, 1)
        return hot_keys(rows, "dst", threshold) if n > threshold else (rows.select("dst").limit(0), 0)

    def aged(self, messages: DataFrame) -> DataFrame:
        """``messages`` with the age that they have once they are added."""
        return messages.withColumn("age", F.lit(self.age))

    def _logged(self) -> list[DataFrame]:
        """The log as rows (dst, src, msg, age): one scan of all written tables, so a plan does not grow with the log."""
        marked = [t for t, _ in self.log if "age" in t.columns]
        other = [t.withColumn("age", F.lit(self.age - len(self.log) + k)) for k, (t, _) in enumerate(self.log) if "age" not in t.columns]
        if len(marked) > 1:
            paths = sorted({p for t in marked for p in _paths(t)})
            marked = [marked[0].sparkSession.read.schema(marked[0].schema).parquet(*paths)]
        return other + marked

    def _latest(self, pick: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame | None:
        """The latest message of each (dst, src) among the rows that ``pick`` leaves of the log."""
        out = None
        for table in self._logged():
            rows = pick(table).select("dst", "src", "msg", "age")
            out = rows if out is None else out.unionByName(rows)
        if out is None or len(self.log) + (self.base is not None) == 1:
            return out if out is None else out.drop("age")
        # max_by skips no NULL message: a forgotten one hides what is older.
        return out.groupBy("dst", "src").agg(F.max_by("msg", "age").alias("msg"))

    def _tables(self, pick: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame | None:
        """The latest message of each (dst, src) among the rows that ``pick`` leaves of each table."""
        later = self._latest(pick)
        if self.base is None:
            return later
        base = pick(self.base.select("dst", "src", "msg"))
        if later is None:
            return base
        hidden = later.select("dst", "src")
        small = F.broadcast(hidden) if self.logged <= self.broadcast_rows else hidden
        return base.join(small, ["dst", "src"], "left_anti").unionByName(later)

    @property
    def logged(self) -> int:
        return sum(n for _, n in self.log)

    @property
    def empty(self) -> bool:
        return self.base is None and not self.log

    def rows(self) -> DataFrame | None:
        """All remembered messages."""
        rows = self._tables()
        return rows if rows is None else rows.where(F.col("msg").isNotNull())

    def _some(self, keys: DataFrame, n: int, on: list[str]) -> DataFrame | None:
        small = F.broadcast(keys) if n <= self.broadcast_rows else keys
        return self._tables(lambda t: t.join(small, on, "left_semi"))

    def last(self, offered: DataFrame, n: int) -> DataFrame:
        """``offered`` (dst, src, ...) with the remembered message as ``last``."""
        rows = self._some(offered.select("dst", "src"), n, ["dst", "src"])
        if rows is None:
            return offered.withColumn("last", F.lit(None))
        rows = rows.withColumnRenamed("msg", "last")
        # (dst, src) is a key of the edges, so these are no more rows than were offered.
        return offered.join(F.broadcast(rows) if n <= self.broadcast_rows else rows, ["dst", "src"], "left")

    def digests(self, receivers: DataFrame, n: int, digest: Callable[[Column], Column]) -> DataFrame:
        """(v, digest) over all that each receiver (dst) remembers; a receiver may be named more than once."""
        receivers = receivers if n <= self.broadcast_rows else receivers.distinct()
        rows = self._some(receivers, n, ["dst"])
        return rows.groupBy(F.col("dst").alias("v")).agg(digest(F.col("msg")).alias("digest"))

    def add(self, messages: DataFrame, n: int, private: bool = False) -> None:
        """``private``: a written table that nobody else reads."""
        if private:
            self.private.update(_paths(messages))
        self.log.append((messages, n))
        self.age += 1
        if len(self.log) > MERGE_TABLES or (self.base is not None and self.logged > MERGE_SHARE * self.base_rows):
            self.merge()

    def merge(self) -> None:
        """The log becomes part of the base; a base is read bucket by bucket and not shuffled."""
        if not self.log:
            return
        later = self._latest()
        if self.hot is None:
            self.buckets = bucket_count(self.logged, self.partitions)
            self.hot = self._hot(later, self.logged)
        if self.base is None:
            rows = with_slot(later.where(F.col("msg").isNotNull()), "dst", "src", self.hot, self.buckets).withColumn("sent", F.lit(True))
        else:
            later = with_slot(later, "dst", "src", self.hot).withColumnRenamed("msg", "later").withColumn("told", F.lit(True))
            rows = self._beside(later).withColumn("msg", F.when(F.col("told"), F.col("later")).otherwise(F.col("last")))
            rows = rows.withColumn("sent", F.coalesce(F.col("told"), F.lit(False))).where(F.col("msg").isNotNull())
        self._write(rows)

    def _beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` (slot, dst, src, ...), one for each (dst, src), beside those of the base, whose message is ``last``."""
        base = self.base.select("slot", "dst", "src", F.col("msg").alias("last"))
        return base.join(rows.hint("shuffle_hash"), ["slot", "dst", "src"], "full_outer")

    def _write(self, rows: DataFrame) -> int:
        """A new base of ``rows`` in place of all that is remembered; the number of rows that are ``sent``."""
        rows = rows.select("slot", "dst", "src", "msg", "sent")
        self.base, path, self.base_rows, n_sent = write_buckets(rows, "memory", self.buckets, ["slot"], ["slot", "dst", "src"], F.col("sent"))
        self.log, self.merged, self.private = [], self.merged | self.private, {path}
        return n_sent

    def sweep(self) -> None:
        """Delete what is merged, once nothing that reads it is still to be run."""
        for p in self.merged:
            delete_table(self.base.sparkSession, p)
        self.merged = set()

    def absorb(self, offered: DataFrame, message: Column) -> int:
        """Take the ``message`` of each row of ``offered`` (dst, src, ...) that differs from ``last``; their number.

        The messages are joined to the base where it lies, and the next base is written in the same pass.
        """
        self.merge()
        self.sweep()
        offered = with_slot(offered, "dst", "src", self.hot).withColumn("asked", F.lit(True))
        rows = self._beside(offered).withColumn("new", message)
        sent = F.col("asked") & F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("last"))
        rows = rows.withColumn("sent", F.coalesce(sent, F.lit(False)))
        rows = rows.withColumn("msg", F.when(F.col("sent"), F.col("new")).otherwise(F.col("last")))
        return self._write(rows.where(F.col("msg").isNotNull()))

    def digests_of_sent(self, digest: Callable[[Column], Column]) -> DataFrame:
        """(v, digest) over all that each receiver of the messages remembers that the base was written with."""
        rows = self.base.groupBy(F.col("dst").alias("v")).agg(digest(F.col("msg")).alias("digest"), F.bool_or("sent").alias("sent"))
        return rows.where("sent").drop("sent")


@dataclass
class MemoRun:
    """The final state and memory; both can start another run."""

    state: DataFrame
    memory: Memory
    stats: RunStats


def _changed(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    return out


def pregel_memo(
    edges: DataFrame | Adjacency,
    state: DataFrame,
    send: Callable[[Values, Values, Column, Column], Column],
    digest: Callable[[Column], Column],
    update: Callable[[Values, Column, Column], dict[str, Column]],
    initial: Column | None = None,
    memory: Memory | None = None,
    start: DataFrame | None = None,
    forgotten: DataFrame | None = None,
    watch: list[str] | None = None,
    receiver: list[str] | None = None,
    max_rounds: int | None = None,
    partitions: int | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_hot_rows: int = DEFAULT_MIN_HOT_ROWS,
    reads_last: bool = True,
) -> MemoRun:
    """Run to a fixpoint from ``state(v, ...)``, a row per vertex.

    ``start``: vertices ``(v)`` whose out-edges are looked at first (default:
    all); ``forgotten``: edges ``(dst, src)`` that are gone, whose messages are
    dropped from ``memory``; ``watch``: columns whose change makes a vertex
    send (default: all); ``receiver``: columns that ``send`` reads by ``dst``;
    ``reads_last``: False if ``send`` does not read ``last``, then messages are
    made beside the edges and nothing else of an offer is shuffled.
    """
    with on_buckets(state.sparkSession):
        return _pregel_memo(
            edges, state, send, digest, update, initial, memory, start, forgotten, watch, receiver, max_rounds, partitions, broadcast_rows, min_hot_rows, reads_last
        )


def _pregel_memo(edges, state, send, digest, update, initial, memory, start, forgotten, watch, receiver, max_rounds, partitions, broadcast_rows, min_hot_rows, reads_last) -> MemoRun:
    spark = state.sparkSession
    n = num_partitions(spark, partitions)
    stats = RunStats()
    names = [c for c in state.columns if c != "v"]
    watch = names if watch is None else watch
    own = edges is not None and not isinstance(edges, Adjacency)
    adjacency = Adjacency.build(prepare_edges(edges), "src", "dst", n, broadcast_rows, min_hot_rows, stored=True) if own else edges
    memory = memory or Memory(n, broadcast_rows, min_hot_rows=min_hot_rows)
    memory.prepare(adjacency)
    # No round of a small graph has many offers, so its vertices need no degrees.
    large = adjacency.rows + adjacency.n_changes > broadcast_rows

    def stepped(rows: DataFrame, combined: Column, got: Column) -> DataFrame:
        """All vertices with new values; ``fresh`` where a watched one changed."""
        new = update(F.col, combined, got)
        rows = rows.select("v", *names, "__out_degree", *[new.get(c, F.col(c)).alias(f"__new_{c}") for c in names])
        return rows.select("v", *[F.col(f"__new_{c}").alias(c) for c in names], "__out_degree", _changed(watch).alias("fresh"))

    def written(rows: DataFrame) -> tuple[DataFrame, str, int, int]:
        """A state read back from a table, its path, the number of its fresh vertices and of their out-edges."""
        seen = Observation("offers")
        rows = rows.observe(seen, F.sum(F.when(F.col("fresh"), F.col("__out_degree"))).alias("offers"))
        path, active = write_table(rows, "state", only=F.col("fresh"))
        return spark.read.schema(rows.schema).parquet(path), path, active, int(seen.get["offers"] or 0)

    first = state.select("v", *names)
    if large:
        degrees = adjacency.edges().groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("__out_degree"))
        first = first.join(degrees, "v", "left")
    else:
        first = first.withColumn("__out_degree", F.lit(0).cast("bigint"))
    if initial is not None:
        first = stepped(first, initial, F.lit(False)).drop("fresh")
    mark = F.lit(True)
    if start is not None:
        first = first.join(start.select("v", F.lit(True).alias("fresh")).distinct(), "v", "left")
        mark = F.coalesce(F.col("fresh"), F.lit(False))
    state, path, active, asked = written(first.select("v", *names, "__out_degree", mark.alias("fresh")))
    gone = forgotten.select("dst", "src", F.lit(None).alias("msg")) if forgotten is not None else None
    while active or gone is not None:
        frontier = state.where("fresh").select(F.col("v").alias("src"), *[F.col(c).alias(f"s_{c}") for c in names])
        offered = adjacency.expand(frontier, active)
        if receiver:
            ends = state.select(F.col("v").alias("dst"), *[F.col(c).alias(f"r_{c}") for c in receiver])
            offered = offered.join(ends, "dst")
        msg = send(lambda c: F.col(f"s_{c}"), lambda c: F.col(f"r_{c}"), F.col("weight"), F.col("last") if reads_last else F.lit(None))
        if not reads_last:
            offered, msg = offered.select("dst", "src", msg.alias("offer")).where(F.col("offer").isNotNull()), F.col("offer")
        absorbed = asked > broadcast_rows and gone is None and not memory.empty
        if absorbed:
            n_sent = memory.absorb(offered, msg)
        else:
            scratch = None
            if memory.empty:
                sent = offered.withColumn("last", F.lit(None))
            else:
                offered, n_offered = write_frontier(offered, "offered")
                scratch = _paths(offered)
                sent = memory.last(offered, n_offered)
            sent = sent.select("dst", "src", msg.alias("msg"), "last").where(F.col("msg").isNotNull() & ~F.col("msg").eqNullSafe(F.col("last")))
            sent = sent.select("dst", "src", "msg")
            if gone is not None:
                sent, gone = sent.unionByName(gone), None
            sent, n_sent = write_frontier(memory.aged(sent), "messages")
            for p in scratch or ():
                delete_table(spark, p)
        if not n_sent:
            break
        if max_rounds is not None and stats.rounds >= max_rounds:
            raise NotConverged(f"{n_sent} messages still to be sent after {stats.rounds} rounds")
        stats.rounds += 1
        stats.frontier_sizes.append(n_sent)
        if absorbed:
            combined = memory.digests_of_sent(digest)
        else:
            receivers = sent.select("dst")
            memory.add(sent, n_sent, private=True)
            combined = memory.digests(receivers, n_sent, digest)
        combined = combined.withColumn("got", F.lit(True))
        # There are no more digests than messages.
        small = F.broadcast(combined) if n_sent <= broadcast_rows else combined.hint("shuffle_hash")
        rows = state.join(small, "v", "left")
        got = F.coalesce(F.col("got"), F.lit(False))
        after = stepped(rows.select("v", *names, "__out_degree", "digest", got.alias("got")), F.col("digest"), F.col("got"))
        # Who got no message keeps its values.
        before = path
        state, path, active, asked = written(after)
        delete_table(spark, before)
        memory.sweep()
    if memory.logged > broadcast_rows and memory.base is not None:
        memory.merge()
    memory.sweep()
    if own:
        adjacency.release()
        if adjacency.path:
            delete_table(spark, adjacency.path)
    return MemoRun(state.select("v", *names), memory, stats)


def sssp_memo(edges: DataFrame | Adjacency, state: DataFrame, source: int = 0, **options) -> MemoRun:
    """Shortest distances by remembered messages, from ``state(v, d, disturbed)``.

    ``disturbed`` is 1 for a vertex that got a message in this run.
    """

    def send(src: Values, dst: Values, weight: Column, last: Column) -> Column:
        return message(src("d"), weight)

    def update(own: Values, least: Column, got: Column) -> dict[str, Column]:
        moves = got & (own("v") != F.lit(source))
        return {"d": F.when(moves, least).otherwise(own("d")), "disturbed": F.when(got, F.lit(1)).otherwise(own("disturbed"))}

    return pregel_memo(edges, state, send, F.min, update, watch=["d"], reads_last=False, **options)

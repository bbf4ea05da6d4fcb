"""Edge updates as a stream, and distances kept current from it.

Sources: Kafka (``key``/``value`` strings; the value is ``"src dst weight"``
optionally followed by a sequence number) or any text file stream with the
same lines.  When a line has no sequence number, Kafka's ``(partition,
offset)`` orders it -- Kafka only orders within a partition, so producers key
messages by ``"src dst"``.

``DistanceMaintainer`` is the ``foreachBatch`` sink: per micro-batch it
takes the last update per edge by ``seq``, looks these edges up in the stored
ones, updates distances incrementally and commits a version that has a delta
of edges and a delta of distances more (:mod:`deltapath.streaming.store`).
The edge layout and the distances stay in memory between batches; after a
restart they are read from the last version.  A batch that a version contains
already is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_edge_line
from ..operators.changes import latest_updates
from ..operators.graph import prepare_edges
from ..plans.lineage import write_frontier
from ..plans.live import LiveDistances
from .store import Folder, Store, Table, Version

# Fixed values of the original stream program: topic name and batch interval.
DEFAULT_TOPIC = "updates"
DEFAULT_TRIGGER = "5 seconds"


def parse_update_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Text rows ``"src dst weight seq"`` -> ``(src, dst, weight, seq)``."""
    return lines.select(*parse_edge_line(F.col(column), strict=strict, with_seq=True))


def file_update_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_update_lines(reader.load(path))


def kafka_update_stream(spark: SparkSession, bootstrap_servers: str, topic: str = DEFAULT_TOPIC) -> tuple[DataFrame, DataFrame]:
    """Kafka source (needs the spark-sql-kafka package on the classpath): updates, and malformed rows for a sink of their own."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .load()
    )
    return parse_kafka_rows(raw)


def parse_kafka_rows(raw: DataFrame, explicit_seq: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of Kafka shape (value, partition, offset) -> updates ``(src, dst, weight, seq)``, and the rows that are none.

    ``seq`` is the place in Kafka's order, or with ``explicit_seq`` the line's
    fourth token; the two are never mixed.  A malformed line can't stop the
    stream: it goes to the second frame, ``(value, partition, offset)``, which
    the caller writes or counts.
    """
    place = (F.col("partition").cast("bigint") * F.lit(1 << 40) + F.col("offset")).alias("seq")
    text = F.col("value").cast("string")
    tokens = parse_edge_line(text, strict=False, with_seq=explicit_seq)
    parsed = raw.select(text.alias("value"), "partition", "offset", F.struct(*tokens, *([] if explicit_seq else [place])).alias("row"))
    whole = F.lit(True)
    for name in ("src", "dst", "weight", "seq"):
        whole = whole & F.col(f"row.{name}").isNotNull()
    # A weight that no relaxation settles on is malformed as well.
    whole = whole & ~F.isnan("row.weight") & (F.col("row.weight") >= 0)
    good = F.coalesce(whole, F.lit(False))
    return parsed.where(good).select("row.*"), parsed.where(~good).select("value", "partition", "offset")


def print_head(stream: DataFrame, checkpoint: str, rows: int = 10, trigger: dict | None = None, out: Callable[[str], None] = print):
    """Print the first rows of every micro-batch (what the original stream program did); returns the query."""

    def show(batch: DataFrame, batch_id: int) -> None:
        head = batch.limit(rows).collect()  # the feature: a bounded head
        out("\n".join([f"batch {batch_id}", *(" ".join(str(x) for x in r) for r in head)]))

    writer = stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": DEFAULT_TRIGGER})).start()


EDGES = Table("edges", "src bigint, dst bigint, weight double, seq bigint", ("src", "dst"), "src")
DIST = Table("dist", "v bigint, d double, parent bigint", ("v",), "v")


@dataclass
class DistanceMaintainer:
    """``foreachBatch`` handler that keeps versions of edges and distances under ``state_path``.

    ``checkpoint`` is the checkpoint folder of the streaming query: it tells
    this query's batch numbers from another one's.
    """

    state_path: str
    checkpoint: str
    source: int = 0
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._live: LiveDistances | None = None
        self._at = -1

    def store(self, spark: SparkSession) -> Store:
        return Store(spark, self.state_path, [EDGES, DIST])

    def _query_id(self, spark: SparkSession) -> str:
        """Id of the streaming query: the same at each restart from its checkpoint, a new one for a new checkpoint."""
        return json.loads(Folder(spark, self.checkpoint).read("metadata"))["id"]

    def latest(self, spark: SparkSession) -> tuple[int, DataFrame, DataFrame] | None:
        """Number, edges (src, dst, weight, seq) and distances (v, d, parent) of the last version."""
        store = self.store(spark)
        version = store.latest()
        if version is None:
            return None
        return version.number, store.read("edges", version.tables["edges"]), store.read("dist", version.tables["dist"])

    def initialize(self, edges: DataFrame) -> None:
        """Version 0: the base edges and their full distances."""
        store = self.store(edges.sparkSession)
        base = store.write_base("edges", prepare_edges(edges).withColumn("seq", F.lit(None).cast("bigint")), 0)
        self._live = LiveDistances.build(store.read("edges", base), self.source, validate=False, **self.options)
        store.commit(Version(0, {"edges": base, "dist": store.write_base("dist", self._live.state, 0)}))
        self._at = 0

    def _current(self, store: Store, version: Version) -> LiveDistances:
        if self._live is None or self._at != version.number:
            edges, dist = (store.read(name, version.tables[name]) for name in ("edges", "dist"))
            self._live = LiveDistances.build(edges, self.source, validate=False, state=dist, **self.options)
            self._at = version.number
        return self._live

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store, query = self.store(spark), self._query_id(spark)
        version = store.latest()
        if batch_id <= version.batches.get(query, -1):
            return  # replay of a batch that this query has committed
        number = version.number + 1
        tables = dict(version.tables)
        latest, n = write_frontier(latest_updates(batch), "updates")
        # Last write wins by seq across batches too: an update older than the
        # stored one is ignored, whatever order the batches arrive in.
        stored = store.read("edges", tables["edges"], latest.select("src", "dst"), n)
        stored = stored.select("src", "dst", F.col("weight").alias("old_w"), F.col("seq").alias("old_seq"))
        stored = F.broadcast(stored) if n <= store.broadcast_rows else stored  # no more than the batch's keys
        newer = latest.join(stored, ["src", "dst"], "left").where("old_seq is null or seq > old_seq")
        newer, n_newer = write_frontier(newer, "newer")
        live = self._current(store, version)
        after = live
        if n_newer:
            tables["edges"] = store.write_delta("edges", newer, tables["edges"], number)
            delta = newer.where(~F.col("old_w").eqNullSafe(F.col("weight"))).select("src", "dst", "old_w", F.col("weight").alias("new_w"))
            change = live.change(*write_frontier(delta, "delta"))
            after = change.after
            if after is not live:
                tables["dist"] = store.write_delta("dist", change.rows(), tables["dist"], number)
        for name in tables:
            tables[name] = store.compacted(name, tables[name], number)
        store.commit(Version(number, tables, {**version.batches, query: batch_id}))
        if after is not live:
            live.retire(after)
        self._live, self._at = after, number


def maintain_distances(
    updates: DataFrame,
    base_edges: DataFrame,
    state_path: str,
    checkpoint_location: str,
    source: int = 0,
    trigger: dict | None = None,
    **options,
):
    """Start the streaming query that keeps distances current; returns (query, maintainer)."""
    maintainer = DistanceMaintainer(state_path, checkpoint_location, source, options)
    if maintainer.latest(base_edges.sparkSession) is None:
        maintainer.initialize(base_edges)
    trig = trigger or {"processingTime": DEFAULT_TRIGGER}
    query = (
        updates.writeStream.foreachBatch(maintainer)
        .option("checkpointLocation", checkpoint_location)
        .trigger(**trig)
        .start()
    )
    return query, maintainer

"""Versioned tables for a stream: a base, one delta per batch, merge on read, compaction.

A table is a folder of parts: a base, whose rows are in folders by a hash
bucket of the bucket column, and deltas with the rows that a batch wrote.  The
latest row of a key wins.  What belongs to a version is named in its manifest,
one small file for all tables together, which is written under a temporary
name and renamed: a version is there whole or not at all, and two writers
cannot commit the same one.  A batch writes its delta only; when the deltas
have grown to a share of the base, or are many, they are merged into a new
base.  Manifests and parts that no kept version names are deleted, so the
number of files does not grow with the number of batches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjacency import DEFAULT_BROADCAST_ROWS
from ..plans.lineage import write_frontier

#: Folders that a base is split into; a reader of few keys lists and reads only theirs.
BUCKETS = 32
#: Deltas are merged into the base beyond this share of its rows, or this many.
COMPACT_SHARE, COMPACT_DELTAS = 0.25, 16
#: Versions whose parts stay for queries that began before the last commits.
KEEP_VERSIONS = 3


class Folder:
    """A folder of a Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, under: str = "") -> list[str]:
        at = self._at(under)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that is there whole or not at all; False if there is one already."""
        if self._fs.exists(self._at(name)):
            return False
        temporary = self._at(f"_new-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return bool(self._fs.rename(temporary, self._at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        """Bytes below a name."""
        at = self._at(name)
        return int(self._fs.getContentSummary(at).getLength()) if self._fs.exists(at) else 0


@dataclass
class Parts:
    """The parts of a table at a version, with their row counts."""

    base: str
    rows: int
    deltas: list[tuple[str, int]] = field(default_factory=list)

    @property
    def delta_rows(self) -> int:
        return sum(n for _, n in self.deltas)

    def names(self) -> list[str]:
        return [self.base, *(name for name, _ in self.deltas)]


@dataclass
class Version:
    number: int
    tables: dict[str, Parts]
    #: The last batch of each streaming query that is contained.
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        tables = {name: {"base": p.base, "rows": p.rows, "deltas": p.deltas} for name, p in self.tables.items()}
        return json.dumps({"version": self.number, "tables": tables, "batches": self.batches})

    @classmethod
    def from_json(cls, text: str) -> "Version":
        data = json.loads(text)
        tables = {name: Parts(p["base"], p["rows"], [(d, n) for d, n in p["deltas"]]) for name, p in data["tables"].items()}
        return cls(data["version"], tables, data["batches"])


@dataclass(frozen=True)
class Table:
    """Name, schema, key columns and the column whose hash deals rows into buckets."""

    name: str
    schema: str
    keys: tuple[str, ...]
    bucket: str


class Store:
    """Tables under one folder, versioned together."""

    def __init__(self, spark: SparkSession, path: str, tables: list[Table], broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self.tables = {t.name: t for t in tables}
        self.broadcast_rows = broadcast_rows

    def latest(self) -> Version | None:
        names = [n for n in self.folder.names("versions") if n.endswith(".json")]
        return Version.from_json(self.folder.read(f"versions/{names[-1]}")) if names else None

    def commit(self, version: Version) -> None:
        if not self.folder.create(f"versions/{version.number:012d}.json", version.to_json()):
            raise RuntimeError(f"version {version.number} of {self.path} has been committed by another writer")
        self._clean()

    def _clean(self) -> None:
        """Delete what no kept version names; parts of a version that is being written are newer than all of them."""
        names = [n for n in self.folder.names("versions") if n.endswith(".json")]
        kept = [Version.from_json(self.folder.read(f"versions/{n}")) for n in names[-KEEP_VERSIONS:]]
        for n in names[:-KEEP_VERSIONS]:
            self.folder.delete(f"versions/{n}")
        for table in self.tables:
            used = {part for v in kept if table in v.tables for part in v.tables[table].names()}
            for part in self.folder.names(table):
                if part not in used and int(part.rsplit("-", 1)[1]) <= kept[-1].number:
                    self.folder.delete(f"{table}/{part}")

    def _bucket(self, table: Table):
        return F.pmod(F.xxhash64(table.bucket), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _columns(self, table: Table) -> list[str]:
        return [c.split()[0] for c in table.schema.split(", ")]

    def write_base(self, name: str, rows: DataFrame, number: int) -> Parts:
        table = self.tables[name]
        part = f"base-{number}"
        rows = rows.select(*self._columns(table), self._bucket(table))
        # A bucket's rows lie in one or a few files; the second key spreads a hot bucket.
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        spread = F.pmod(F.xxhash64(*table.keys), F.lit(max(1, n // BUCKETS)))
        dealt = rows.repartition(n, "bucket", spread)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/{part}")
        return Parts(part, self.spark.read.schema(f"{table.schema}, bucket int").parquet(f"{self.path}/{name}/{part}").count())

    def write_delta(self, name: str, rows: DataFrame, parts: Parts, number: int) -> Parts:
        """The parts with one more delta; what an earlier try for this version left is replaced."""
        part = f"delta-{number}"
        rows, n = write_frontier(rows.select(*self._columns(self.tables[name])), "delta")
        if not n:
            return parts
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{part}")
        return Parts(parts.base, parts.rows, [*parts.deltas, (part, n)])

    def compacted(self, name: str, parts: Parts, number: int) -> Parts:
        """A new base if the deltas have grown too much, else the parts as they are."""
        if len(parts.deltas) <= COMPACT_DELTAS and parts.delta_rows <= COMPACT_SHARE * max(parts.rows, 1):
            return parts
        return self.write_base(name, self.read(name, parts), number)

    def _deltas(self, name: str, parts: Parts) -> DataFrame | None:
        table = self.tables[name]
        out = None
        for part, _ in parts.deltas:
            rows = self.spark.read.schema(table.schema).parquet(f"{self.path}/{name}/{part}")
            rows = rows.withColumn("age", F.lit(int(part.rsplit("-", 1)[1])))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return None
        values = [c for c in self._columns(table) if c not in table.keys]
        return out.groupBy(*table.keys).agg(*[F.max_by(c, "age").alias(c) for c in values]).select(*self._columns(table))

    def read(self, name: str, parts: Parts, keys: DataFrame | None = None, n_keys: int = 0) -> DataFrame:
        """Rows at a version.  With ``keys`` (all key columns): only theirs, from the buckets that they are in."""
        table = self.tables[name]
        base = self.spark.read.schema(f"{table.schema}, bucket int").parquet(f"{self.path}/{name}/{parts.base}")
        deltas = self._deltas(name, parts)
        if keys is not None:
            small = F.broadcast(keys) if n_keys <= self.broadcast_rows else keys
            buckets = [r["bucket"] for r in keys.select(self._bucket(table)).distinct().collect()]  # BUCKETS at most
            base = base.where(F.col("bucket").isin(buckets)).join(small, list(table.keys), "left_semi")
            deltas = deltas.join(small, list(table.keys), "left_semi") if deltas is not None else None
        base = base.drop("bucket")
        if deltas is None:
            return base
        hidden = deltas.select(*table.keys)
        hidden = F.broadcast(hidden) if parts.delta_rows <= self.broadcast_rows else hidden
        return base.join(hidden, list(table.keys), "left_anti").unionByName(deltas)

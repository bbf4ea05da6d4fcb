"""Merkle manifest of a dataset with a witness for every row, built by aligned appends.

Each row's leaf is a sha256 of its columns.  The leaves of a language, by
``doc_id``, are the bottom of a tree in which runs of ``FAN`` nodes make one
node above (the last run may be shorter); the languages' roots, in order, are
the bottom of a tree of their own.

The leaves are dealt into blocks of ``FAN ** levels`` consecutive ones, which
are whole subtrees.  A task appends the leaves of a block one by one: a leaf
opens with an empty witness, and whenever a run around it is complete, its
witness grows by the run's other nodes.  The roots of the blocks are appended
further in the same way, until one node is left, and a leaf's witness is its
own part and those of the blocks it is in.  Tasks hold one block; positions
come from range-sorted rows and one small row per range and language, so a
language may hold any share of the rows.

Nulls in any column have a mark of their own in the leaf; a null ``lang`` is a
language, the first one.  Rows with a null ``doc_id`` come first, rows with the
same ``doc_id`` by their leaf; repeated rows are leaves of their own.  An empty
table has no root and no rows.  Columns other than the five play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .common import slices, written

FAN = 8
#: Levels of a block: 4,096 leaves.
LEVELS = 4
#: Witness tables up to so many rows (of about 2 KB) are broadcast.
BROADCAST_ROWS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(hexes: str) -> str:
    return sha256(hexes.encode()).hexdigest()


def levels_over(n: int, levels: int) -> int:
    """Levels of a block's subtree among ``n`` nodes: all of ``levels`` unless the nodes are a single block."""
    level = 0
    while level < levels and FAN**level < n:
        level += 1
    return level


class Appender:
    """Takes nodes in order; ``witness[i]`` is what has been completed around the i-th.

    A witness is a list of entries, from below: the own place in the run, the
    number of the others, the others' hashes.
    """

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels)]
        self.witness: list[bytearray] = []
        self.top = b""

    def append(self, node: bytes) -> None:
        self.witness.append(bytearray())
        self._put(0, node, len(self.witness) - 1, len(self.witness))

    def _put(self, level: int, node: bytes, first: int, last: int) -> None:
        if level == self.levels:
            self.top = node
            return
        self.open[level].append((node, first, last))
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        hashes = [node for node, *_ in run]
        for place, (_, first, last) in enumerate(run):
            entry = bytes((place, len(run) - 1)) + b"".join(hashes[:place] + hashes[place + 1 :])
            for witness in self.witness[first:last]:
                witness += entry
        self._put(level + 1, bytes.fromhex(_hash("".join(h.hex() for h in hashes))), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """Completes the open runs as they are; the root of all."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.top


def fold(node: str, witness: bytes) -> str:
    """The root that a node (as hex text) and its witness give."""
    at = 0
    while at < len(witness):
        place, others = witness[at], witness[at + 1]
        hexes = witness[at + 2 : at + 2 + 32 * others].hex()
        node = _hash(hexes[: 64 * place] + node + hexes[64 * place :])
        at += 2 + 32 * others
    return node


def siblings(witness: bytes) -> str:
    """All hashes of a witness as hex text, level by level."""
    at, out = 0, []
    while at < len(witness):
        end = at + 2 + 32 * witness[at + 1]
        out.append(witness[at + 2 : end].hex())
        at = end
    return "".join(out)


def append_rows(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, pos, n, node, ...) in order of key and pos, blocks whole: the same with the block's ``top`` and the ``witness`` in it."""
    block, parts, tree = None, [], Appender(0)

    def done() -> Iterator[pa.RecordBatch]:
        top, at = tree.close(), 0
        for part in parts:
            own = tree.witness[at : at + part.num_rows]
            at += part.num_rows
            yield part.append_column("witness", pa.array([bytes(w) for w in own], pa.binary())).append_column("top", pa.array([top] * part.num_rows, pa.binary()))

    for batch in batches:
        keys, pos, n = batch.column("key").to_pylist(), batch.column("pos").to_pylist(), batch.column("n").to_pylist()
        nodes = batch.column("node").to_pylist()
        owners = [(k, p // FAN**levels) for k, p in zip(keys, pos)]
        cuts = [i for i in range(batch.num_rows) if not i or owners[i] != owners[i - 1]] + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if owners[a] != block:
                yield from done()
                block, parts, tree = owners[a], [], Appender(levels_over(n[a], levels))
            parts.append(batch.slice(a, b - a))
            for node in nodes[a:b]:
                tree.append(node)
    yield from done()


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, the place among the rows of ``key`` in the given order, and ``n``, their number; the greatest ``n``.

    Rows are sorted within ranges; a range's part of a key is one row of the
    table that gives its first position.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranges")
    parts = dealt.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts, n_parts = write_frontier(parts.select("key", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(whole).alias("n")), "parts")
    most = parts.agg(F.max("n")).first()[0] or 0
    out = dealt.join(_bounded(parts, n_parts), ["key", "part"])
    return out.select(*rows.columns, (F.col("at") - F.col("first") + F.col("base")).alias("pos"), "n"), most


def grown(nodes: DataFrame, most: int, levels: int) -> list[tuple[DataFrame, int]]:
    """Tables (key, pos, n, node, ..., witness, top) with their row counts: of the nodes, of their blocks' roots, of these blocks' roots ..."""
    out, block = [], FAN**levels
    while True:
        dealt = nodes.repartition("key", F.expr(f"pos div {block}")).sortWithinPartitions("key", "pos")
        schema = nodes.schema.simpleString()[len("struct<") : -1].replace(":", " ")
        out.append(write_frontier(dealt.mapInArrow(lambda b: append_rows(b, levels), f"{schema.replace(',', ', ')}, witness binary, top binary"), "witness"))
        if most <= block:
            return out
        most = -(-most // block)
        tops = out[-1][0].where(f"pos % {block} = 0")
        nodes = tops.select("key", F.expr(f"pos div {block}").alias("pos"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), F.col("top").alias("node"))


def joined(tables: list[tuple[DataFrame, int]], tail: DataFrame, n_tail: int, levels: int) -> DataFrame:
    """The first of the tables with whole witnesses; ``tail``: (key, rest, ...) goes on above the last one."""
    extra = [c for c in tail.columns if c not in ("key", "rest")]
    whole = F.concat("witness", "rest").alias("witness")
    table, _ = tables[-1]
    out = table.drop("top").join(_bounded(tail, n_tail), "key").withColumn("witness", whole).drop("rest")
    for (table, _), (_, n_above) in zip(reversed(tables[:-1]), reversed(tables[1:])):
        above = out.select("key", F.col("pos").alias("above"), F.col("witness").alias("rest"), *extra)
        below = table.drop("top").withColumn("above", F.expr(f"pos div {FAN**levels}"))
        out = below.join(_bounded(above, n_above), ["key", "above"]).withColumn("witness", whole).drop("above", "rest")
    return out


def leaf(fields: dict[str, Column]) -> Column:
    """The leaf (hex text): the fields one behind the other, nulls as ``-``, others as byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """(doc_id, lang, pos, leaf, witness, subroot, root), a row per row of ``docs``; hashes are bytes.

    ``pos``: place among the leaves of the language.  ``carried``: further
    columns, computed from a row of ``docs``, that are kept with its leaf.
    """
    # An empty key is the null language; others have a letter in front.
    key = F.coalesce(F.concat(F.lit("l"), docs["lang"].cast("string")), F.lit(""))
    own = F.unhex(leaf({c: docs[c] for c in FIELDS}))
    rows = docs.select(key.alias("key"), docs["doc_id"].cast("long").alias("doc_id"), own.alias("node"), *[c.alias(name) for name, c in carried.items()])
    tables = grown(*numbered(written(rows, "leaves"), "doc_id", "node"), levels)
    roots = tables[-1][0].where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("member"), F.col("top").alias("node"))
    upper = grown(*numbered(written(roots, "roots"), "member"), levels)
    top = upper[-1][0].where("pos = 0").select("key", F.col("top").alias("root"), F.unhex(F.lit("")).alias("rest"))
    above = joined(upper, top, 1, levels).select(F.col("member").alias("key"), F.col("witness").alias("rest"), F.col("node").alias("subroot"), "root")
    above, n_above = write_frontier(above, "subroots")
    lang = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("lang")
    return joined(tables, above, n_above, levels).select("doc_id", lang, "pos", F.col("node").alias("leaf"), "witness", "subroot", "root", *carried)


DIGESTS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, leaf, seen, witness, subroot, root): the root that the leaf as ``seen`` folds to."""
    for batch in slices(batches):
        cols = {name: batch.column(name).to_pylist() for name in ("leaf", "seen", "witness", "subroot", "root")}
        folded = [fold(seen.hex(), w) for seen, w in zip(cols["seen"], cols["witness"])]
        root = [r.hex() for r in cols["root"]]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "leaf": pa.array([x.hex() for x in cols["leaf"]], pa.string()),
                "subroot": pa.array([x.hex() for x in cols["subroot"]], pa.string()),
                "root": pa.array(root, pa.string()),
                "proof_sha256": pa.array([_hash(siblings(w)) for w in cols["witness"]], pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array(np.array([a == b for a, b in zip(folded, root)], bool)),
            }
        )


def verified(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The digests of the manifest, and whether each row still folds to the root after tampering.

    Tampering writes small letters for A-Z in the text of the rows where 3
    divides the CRC-32 of the decimal ``doc_id``.
    """
    hit = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 3 == 0
    small = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = F.when(hit, F.unhex(leaf({c: docs[c] for c in FIELDS} | {"text": small})))
    rows = manifest(docs, levels, seen=seen).withColumn("seen", F.coalesce("seen", "leaf"))
    return rows.select("doc_id", "leaf", "seen", "witness", "subroot", "root").mapInArrow(fold_rows, DIGESTS)

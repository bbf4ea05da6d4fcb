"""Jaccard join of shingle sets, filtered under several global orders of the shingles.

A text's set holds its distinct runs of ``WORDS`` words (A-Z as small letters).
If two sets have a Jaccard similarity of at least ``PERCENT`` per cent, then
under ANY order of all shingles they share one among the first ``size -
ceil(PERCENT * size / 100) + 1`` of each (its prefix).  ``ORDERS`` orders are
used: each puts another class of the shingles (by their hash) first, and in a
class the rarer ones before the more frequent, by counts of hashed buckets
over all texts.  So a pair has to share rare shingles in several independent
parts of the sets.  Texts that share a shingle of their first prefix meet in a
bucket; the sizes and the prefixes under all orders are compared before the
sets are.  Where a set's prefixes have no shingle in common, the filters are
intersected more sharply: a shingle that the other set lacks weakens one order
only, so over all orders the prefixes share at least ``ORDERS`` times the
shorter one's length less the shingles that the two sets may differ in.

Texts with the same set are one node.  In each bucket all nodes are compared
with ``STARS`` of its nodes (the least under as many hashes).  Links make
components.  The other nodes of a bucket are dealt into cells of like sizes;
where a cell holds several components, nodes of different components are
compared block by block inside tasks: first by prefixes, which leaves the
nodes that still have a possible partner, then these by their sets; only links
between components leave the task.  Blocks of one component are never put
against each other, and a component with a large part of a bucket is compared
with all its outsiders once, not once per bucket.  So no link between
components is lost, no pairs are written out but those with a star, and no
bucket has a size limit.  Sets are read again from the texts, of the nodes
whose prefixes let them link.

Shingles are 64-bit hashes; sets are told apart by 128-bit digests.  Texts of
fewer words are one shingle of all of them; texts without words, and null
texts, have empty sets and link with nothing.  Rows with a null ``doc_id``
come last in the order that names components.  Repeated rows fall into one
component.  Empty tables give empty results, other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .blocks import GROUP_COLUMNS, bounded, dealt, sides_of
from .common import RollingHash, Texts, id_text, mix64, sized, slices, word_bounds, written
from .graph import components

WORDS = 3
PERCENT = 90
ORDERS = 3
STARS = 3
#: Nodes of a block.
GROUP = 256
#: Members of a star that are compared by one group.
PART = 64
#: Sets that a task compares with their stars.
SETS_PER_TASK = 4_000
SLICE = 1 << 20
#: The counts that order shingles: buckets of hashes (a byte of broadcast each), in segments that are summed on their own.
SKETCH_BITS, SEGMENT_BITS = 24, 18
_A, _B = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1342543DE82EF95)


def token_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, ascending within a text, and the bounds of each text's (n + 1 entries)."""
    t.buf = np.where((t.buf >= 65) & (t.buf <= 90), t.buf + np.uint8(32), t.buf).astype(np.uint8)
    starts, ends, first = word_bounds(t)
    words = mix64(RollingHash(t.buf).of(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.diff(first)
    text = np.repeat(np.arange(t.n), n_words)
    m = max(0, len(words) - WORDS + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            h = mix64(h * _A + words[j : j + m])
        keep = text[:m] == text[WORDS - 1 :][:m]
        tokens, of = [h[keep]], [text[:m][keep]]
        for n in range(1, WORDS):
            own = np.flatnonzero(n_words == n)
            h = np.full(len(own), n, np.uint64)
            for j in range(n):
                h = mix64(h * _B + words[first[:-1][own] + j])
            tokens.append(h)
            of.append(own)
    all_, whose = np.concatenate(tokens), np.concatenate(of)
    order = np.lexsort((all_, whose))
    all_, whose = all_[order], whose[order]
    new = np.append(True, (all_[1:] != all_[:-1]) | (whose[1:] != whose[:-1]))[: len(all_)]
    all_, whose = all_[new], whose[new]
    return all_, np.searchsorted(whose, np.arange(t.n + 1))


def least_overlap(size):
    """The fewest shingles that a set of this size shares with a set it links with."""
    return -(-PERCENT * size // 100)


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both) and both > 0


def prefixes(tokens: np.ndarray, cut: np.ndarray, rarity: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the prefixes of all sets and their bounds.  ``rarity``: class of each bucket of hashes, rare ones low."""
    size = np.diff(cut)
    length = np.where(size > 0, size - least_overlap(size) + 1, 0)
    to = np.append(0, np.cumsum(length))
    at = np.repeat(cut[:-1] - to[:-1], length) + np.arange(to[-1])
    of = np.repeat(np.arange(len(size)), size)
    place = (mix64(tokens) % np.uint64(ORDERS)).astype(np.int64)
    rare = rarity[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
    out = []
    for j in range(ORDERS):
        # Stable: within a class and a rarity the hashes ascend, so the order is the same for all sets.
        order = np.argsort(of * (256 * ORDERS) + (place - j) % ORDERS * 256 + rare, kind="stable")
        out.append((tokens[order][at], to))
    return out


COUNT_SCHEMA = "segment int, small binary, places binary, large binary"


def count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all buckets of a partition's shingles, a row per segment: a byte each, and those that need more."""
    # Two bytes are enough: beyond them a partition's count stands still, which only the order of shingles sees.
    counts, some = np.zeros(1 << SKETCH_BITS, np.uint16), False
    for batch in slices(batches, SLICE):
        tokens, _ = token_sets(Texts(batch.column("text")))
        places, n = np.unique((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
        counts[places] = np.minimum(counts[places] + n, 65_535)
        some = some or len(places) > 0
    for segment, part in enumerate(counts.reshape(-1, 1 << SEGMENT_BITS) if some else ()):
        large = np.flatnonzero(part > 255)
        small = pa.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), "zstd", asbytes=True)
        yield pa.record_batch({"segment": pa.array([segment], pa.int32()), "small": [small], "places": [large.astype("<i8").tobytes()], "large": [part[large].astype("<u2").tobytes()]})


def sum_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each bucket's sum, four classes for each power of two."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(pa.decompress(row["small"], 1 << SEGMENT_BITS, "zstd", asbytes=True), np.uint8).astype(np.int64)
            part[np.frombuffer(row["places"], "<i8")] = np.frombuffer(row["large"], "<u2")
            if row["segment"] in sums:
                sums[row["segment"]] += part
            else:
                sums[row["segment"]] = part
    for segment, counts in sums.items():
        classes = np.minimum(4 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)
        yield pa.record_batch({"segment": pa.array([segment], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})


def rarities(texts: DataFrame) -> Broadcast:
    """The class of every bucket: ``2**SKETCH_BITS`` bytes, whatever the number of texts."""
    segments = 1 << (SKETCH_BITS - SEGMENT_BITS)
    parts = texts.mapInArrow(count_rows, COUNT_SCHEMA).repartition(segments, "segment")
    rarity = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in parts.mapInArrow(sum_rows, "segment int, classes binary").collect():
        rarity[row["segment"] << SEGMENT_BITS : (row["segment"] + 1) << SEGMENT_BITS] = np.frombuffer(row["classes"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(rarity)


#: ``marks``: the prefixes under all orders, 16 bits of each shingle, ascending; ``apart``: whether the prefixes have no shingle in common.
SET_SCHEMA = "doc_id long, digest binary, n long, own boolean, p0 array<long>, marks binary, apart boolean, tokens binary"


def set_rows(batches: Iterable[pa.RecordBatch], rarity: Broadcast, whole: bool) -> Iterator[pa.RecordBatch]:
    """A row per text: its set's digest and size and, at a set's first place in the partition (``own``), prefixes and (``whole``) shingles."""
    seen: set[bytes] = set()
    for batch in slices(batches, SLICE):
        tokens, cut = token_sets(Texts(batch.column("text")))
        orders = prefixes(tokens, cut, rarity.value)
        to = orders[0][1]
        digest, own, p0, marks, apart, sets = [], [], [], [], [], []
        for i in range(batch.num_rows):
            mine = tokens[cut[i] : cut[i + 1]].tobytes()
            d = hashlib.blake2b(mine, digest_size=16).digest()
            new = len(mine) > 0 and d not in seen
            if new:
                seen.add(d)
            digest.append(d)
            own.append(new)
            own_prefixes = [x[to[i] : to[i + 1]] for x, _ in orders] if new else []
            p0.append(np.sort(own_prefixes[0].view(np.int64)) if new else None)
            marks.append(b"".join(np.sort((x & np.uint64(0xFFFF)).astype("<u2")).tobytes() for x in own_prefixes) if new else None)
            apart.append(len(np.unique(np.concatenate(own_prefixes))) == ORDERS * len(own_prefixes[0]) if new else None)
            sets.append(mine if new and whole else None)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "digest": pa.array(digest, pa.binary()),
                "n": pa.array(np.diff(cut), pa.int64()),
                "own": pa.array(own, pa.bool_()),
                "p0": pa.array(p0, pa.list_(pa.int64())),
                "marks": pa.array(marks, pa.binary()),
                "apart": pa.array(apart, pa.bool_()),
                "tokens": pa.array(sets, pa.binary()),
            }
        )


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Entries of ``b`` that ``a`` holds; both ascend."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def least_common(n_a, n_b, prefix, apart):
    """The fewest entries that the prefixes of two sets share over all orders if the sets link; ``prefix``: the shorter length."""
    differ = n_a + n_b - 2 * -(-PERCENT * (n_a + n_b) // (100 + PERCENT))
    return np.maximum(np.where(apart, ORDERS * prefix - differ, 0), ORDERS)


class Node:
    """A set with its prefixes."""

    __slots__ = ("node", "n", "component", "smaller", "marks", "apart", "tokens", "upper")

    def __init__(self, row: dict) -> None:
        self.node, self.n, self.component = row["node"], row["n"], row["component"]
        #: Shingles of the first prefix that are less than the bucket's.
        self.smaller = np.array(row.get("smaller") or [], np.int64)
        self.upper = row.get("upper")
        self.marks = np.frombuffer(row["marks"], "<u2").reshape(ORDERS, -1)
        self.apart = row["apart"]
        self.tokens = np.frombuffer(row["tokens"], np.uint64) if row["tokens"] is not None else None

    def may_link(self, other: Node) -> bool:
        """The filters of size and of all orders."""
        if 100 * min(self.n, other.n) < PERCENT * max(self.n, other.n):
            return False
        # 16 bits of different shingles may be the same, which can only let a pair through.
        both = [shared(a, b) for a, b in zip(self.marks, other.marks)]
        prefix = min(self.marks.shape[1], other.marks.shape[1])
        return min(both) > 0 and sum(both) >= least_common(self.n, other.n, prefix, self.apart and other.apart)

    def links(self, other: Node) -> bool:
        return linked(shared(self.tokens, other.tokens), self.n, other.n)


LINK_SCHEMA = "u long, v long"


def _link_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array([a for a, _ in rows], pa.int64()), "v": pa.array([b for _, b in rows], pa.int64())})


def star_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (star, part, node, component, n, marks, apart, tokens), a star's own row in front of each part: its links, without sets its possible ones."""
    star = None
    for batch in slices(batches, SLICE, 256):
        out = []
        for row in batch.to_pylist():
            node = Node(row)
            if node.node == row["star"]:
                star = node
            elif star is not None and star.node == row["star"] and star.may_link(node) and (star.tokens is None or star.links(node)):
                out.append((node.node, star.node))
        yield _link_batch(out)


class Joined:
    """Which components have been joined within a group."""

    def __init__(self) -> None:
        self.lead: dict[int, int] = {}

    def root(self, c: int) -> int:
        while self.lead.get(c, c) != c:
            c = self.lead[c]
        return c


def counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many entries of each left array each right one holds."""
    own = np.concatenate([np.unique(np.concatenate(left)), np.unique(np.concatenate(right))])
    both, times = np.unique(own, return_counts=True)
    both = both[times > 1]
    sides = []
    for arrays in (left, right):
        flat = np.concatenate(arrays)
        row = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        matrix = np.zeros((len(arrays), len(both)), np.float32)
        np.add.at(matrix, (row[hit], at[hit]), 1)
        sides.append(matrix)
    return sides[0] @ np.minimum(sides[1], 1).T


def group_pairs(rows: list[tuple[bool, Node]], same: bool) -> Iterator[tuple[Node, Node]]:
    """Pairs of different components that pass the filters: of the left and the right rows, or (``same``) of the left ones.

    A pair meets in each bucket whose shingle both first prefixes hold; it
    counts in the one of the least of them, and in the cell of its greater size.
    """
    left = [x for side, x in rows if side]
    right = left if same else [x for side, x in rows if not side]
    if not left or not right:
        return

    def columns(name: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array([getattr(x, name) for x in left])[:, None], np.array([getattr(x, name) for x in right])

    (own, its), (n, m), (up, upper), (apart, separate) = map(columns, ("component", "n", "upper", "apart"))
    may = (own != its) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (up | upper)
    if same:
        may &= np.tri(len(left), dtype=bool).T & ~np.eye(len(left), dtype=bool)
    if may.any():
        may &= counts([x.smaller for x in left], [x.smaller for x in right]) == 0
    both = np.zeros(may.shape)
    for j in range(ORDERS):
        if may.any():
            shares = counts([x.marks[j] for x in left], [x.marks[j] for x in right])
            may &= shares > 0
            both += shares
    if may.any():
        p, q = (np.array([x.marks.shape[1] for x in side]) for side in (left, right))
        may &= both >= least_common(n, m, np.minimum(p[:, None], q), apart & separate)
    for i, j in zip(*(x.tolist() for x in np.nonzero(may))):
        yield left[i], right[j]


def grouped(batches: Iterable[pa.RecordBatch], group: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple[bool, Node]]]]:
    at, rows = None, []
    for batch in slices(batches, SLICE, 256):
        for row in batch.to_pylist():
            key = tuple(row[c] for c in group)
            if key != at:
                if rows:
                    yield at, rows
                at, rows = key, []
            rows.append((row["left"], Node(row)))
    if rows:
        yield at, rows




def possible_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of blocks: the nodes that have a partner of another component which passes the filters."""
    for key, rows in grouped(batches, GROUP_COLUMNS):
        some: set[int] = set()
        for a, b in group_pairs(rows, key[1] and key[2] == key[3]):
            some |= {a.node, b.node}
        yield pa.record_batch({"token": pa.array([key[0]] * len(some), pa.int64()), "inside": pa.array([key[1]] * len(some), pa.bool_()), "node": pa.array(sorted(some), pa.int64())})


def joining_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of blocks: links that join components."""
    for key, rows in grouped(batches, GROUP_COLUMNS):
        joined, out = Joined(), []
        for a, b in group_pairs(rows, key[1] and key[2] == key[3]):
            u, v = joined.root(a.component), joined.root(b.component)
            if u != v and a.links(b):
                joined.lead[u] = v
                out.append((a.node, b.node))
        yield _link_batch(out)


def _star_links(pairs: DataFrame, n_pairs: int, sets: DataFrame) -> DataFrame:
    """Links (u, v) among ``n_pairs`` pairs (node, star).  A star's members are dealt into parts, each with the star's row in front."""
    parts = pairs.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("n_parts"))
    parts, n = write_frontier(sized(parts, n_pairs), "parts")
    heads = parts.select("star", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.col("star").alias("node"))
    members = pairs.join(bounded(parts, n), "star").select("star", F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int").alias("part"), "node")
    rows = heads.unionByName(members).join(sets.drop("p0"), "node").withColumn("component", F.col("node"))
    dealt = rows.repartition("star", "part").sortWithinPartitions("star", "part", F.col("node") != F.col("star"))
    return sized(dealt, n_pairs, SETS_PER_TASK).mapInArrow(star_links, LINK_SCHEMA)


def _block_groups(sides: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of all pairs of blocks with their sets, group by group."""
    smaller = F.when(F.col("inside"), F.filter("p0", lambda x: x < F.col("base"))).alias("smaller")
    rows = dealt(sides, GROUP).join(sets, "node")
    rows = rows.select(*GROUP_COLUMNS, "left", "node", "component", "upper", "n", smaller, "marks", "apart", "tokens")
    return rows.repartition(*GROUP_COLUMNS).sortWithinPartitions(*GROUP_COLUMNS)


def _cells(members: DataFrame) -> DataFrame:
    """(token, node, base, upper, bytes): the nodes of each bucket (``base``) behind its stars, in the cells of their size; ``token`` is the cell's key.

    Sizes of a possible pair differ by less than a class of a factor of
    ``100 / PERCENT``, so the pair meets in the cell of its greater class,
    where one of the two is an ``upper`` one.
    """
    others = members.where(~F.array_contains(F.transform("stars", lambda x: x["node"]), F.col("node")))
    size_class = F.floor(F.log("n") / (math.log(100 / PERCENT) * 1.000001))  # a little wider, for rounding
    cells = others.select("token", "node", (8 * F.col("n")).alias("bytes"), F.posexplode(F.array(size_class, size_class + 1)).alias("behind", "cell"))
    return cells.select(F.xxhash64("token", "cell").alias("token"), "node", F.col("token").alias("base"), (F.col("behind") == 0).alias("upper"), "bytes")


def _mixed(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of the cells that hold several components."""
    some = F.min("component") != F.max("component")
    mixed = rows.groupBy("token").agg((some & F.bool_or("upper")).alias("x")).where("x").select("token")
    mixed, n_mixed = write_frontier(sized(mixed, n_rows), "mixed")
    return rows.join(bounded(mixed, n_mixed), "token", "left_semi")


def linked_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest, n) of all rows, (digest, node) of all sets, and (node, component) of the nodes that have links."""
    texts = id_text(docs)
    rarity = rarities(texts.select("text"))
    rows = texts.mapInArrow(lambda b: set_rows(b, rarity, False), SET_SCHEMA).drop("tokens")
    rows, n_rows = write_frontier(rows.withColumn("at", F.monotonically_increasing_id()), "prefixes")
    nodes = rows.where("own").groupBy("digest").agg(F.min("at").alias("node"), F.count(F.lit(1)).alias("c"))
    nodes, _ = write_frontier(sized(nodes, n_rows), "sets")
    # Sets that several tasks have met have rows too many.
    several, n_several = write_frontier(nodes.where("c > 1").select("digest", "node"), "several")
    signed = rows.where("own").join(bounded(several, n_several), "digest", "left").where("node is null or node = at")
    signed = signed.select(F.col("at").alias("node"), "n", "p0", "marks", "apart")
    entries = signed.select(F.explode("p0").alias("token"), "node", "n")
    n_entries = rows.where("own").agg(F.coalesce(F.sum(F.size("p0")), F.lit(0))).first()[0]
    buckets = written(sized(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), n_entries), "buckets")
    members, n_members = write_frontier(sized(entries.join(buckets, "token"), n_entries), "members")
    stars = [F.struct(F.min_by("node", F.xxhash64("node", F.lit(r))).alias("node"), F.min_by("n", F.xxhash64("node", F.lit(r))).alias("n")) for r in range(STARS)]
    stars, n_stars = write_frontier(sized(members.groupBy("token").agg(F.array(*stars).alias("stars")), n_members), "stars")
    members = members.join(bounded(stars, n_stars), "token")
    fits = f"node != star.node and 100 * least(n, star.n) >= {PERCENT} * greatest(n, star.n)"
    pairs = members.select("node", "n", F.explode("stars").alias("star")).where(fits).select("node", F.col("star.node").alias("star")).distinct()

    def with_marks(wanted: DataFrame, n: int) -> DataFrame:
        return signed.join(bounded(wanted, n), "node", "left_semi").withColumn("tokens", F.lit(None).cast("binary"))

    def with_sets(wanted: DataFrame, n: int) -> DataFrame:
        """The sets of some nodes, from the texts of the documents that they were first met in."""
        own = rows.where("own").select(F.col("at").alias("node"), "doc_id", "digest").join(bounded(wanted, n), "node")
        own = written(own, "wanted")
        ids = own.select(F.col("doc_id").alias("id")).distinct()
        some = texts.join(bounded(ids, n), texts["doc_id"].eqNullSafe(F.col("id")), "left_semi")
        sets = some.mapInArrow(lambda b: set_rows(b, rarity, True), SET_SCHEMA).where("own").drop("doc_id")
        sets = sets.join(bounded(own.select("digest", "node"), n), "digest").select("node", "n", "p0", "marks", "apart", "tokens")
        return written(sets, "tokens")  # a set that several such documents have comes several times, which does no harm

    def ends(links: DataFrame, n: int, *names: str) -> tuple[DataFrame, int]:
        return write_frontier(sized(links.select(F.explode(F.array(*names)).alias("node")).distinct(), n * len(names)), "ends")

    pairs, n_pairs = write_frontier(sized(pairs, STARS * n_members), "pairs")
    possible, n_pairs = write_frontier(_star_links(pairs, n_pairs, with_marks(*ends(pairs, n_pairs, "node", "star"))), "possible")
    pairs = possible.select(F.col("u").alias("node"), F.col("v").alias("star"))
    links = written(_star_links(pairs, n_pairs, with_sets(*ends(pairs, n_pairs, "node", "star"))), "links")
    found = written(components(links), "components")
    labelled = _cells(members).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells, n_cells = write_frontier(sized(labelled, 2 * n_members), "cells")
    rest, n_rest = write_frontier(sides_of(_mixed(cells, n_cells), GROUP), "mixed-cells")
    if n_rest:
        possible = _block_groups(rest, with_marks(*ends(rest, n_rest, "node"))).mapInArrow(possible_rows, "token long, inside boolean, node long").distinct()
        possible, n_possible = write_frontier(possible, "possible")
        if n_possible:
            less = rest.join(bounded(possible, n_possible), ["token", "inside", "node"], "left_semi")
            further = _block_groups(less, with_sets(*ends(possible, n_possible, "node"))).mapInArrow(joining_rows, LINK_SCHEMA)
            further, n_further = write_frontier(further, "further")
            if n_further:
                found = written(components(links.unionByName(further)), "components")
    return rows.select("doc_id", "digest", "n"), nodes.select("digest", "node"), found


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``; a component is named by its first ``doc_id``."""
    rows, nodes, found = linked_nodes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"))).alias("o")
    per_set = rows.where("n > 0").groupBy("digest").agg(F.min(F.col("doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("c"))
    per_set = per_set.join(nodes, "digest").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per_set, n_sets = write_frontier(sized(per_set, nodes.count()), "components")
    names = per_set.groupBy("component").agg(first, F.sum("c").alias("c")).where("c > 1").select("component", F.col("o.b").alias("name"))
    tags, n_tags = write_frontier(sized(per_set.join(names, "component").select(F.col("digest").alias("tag"), "name"), n_sets), "tags")
    out = rows.join(bounded(tags, n_tags), (rows["digest"] == tags["tag"]) & (rows["n"] > 0), "left")
    component = F.when(F.col("tag").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

"""Near duplicates by weighted MinHash over bags of five-word shingles.

A text is the multiset of its shingles.  Every shingle owns Poisson processes
over its weight axis, hierarchically: one for the weights (0, 1], one for
(1, 2], then (2, 4], (4, 8] and so on, each with a rate of its length.  A
point has a time, a weight level in its interval and a slot of the signature;
it belongs to a text if the text holds the shingle at least ``level`` times.
A slot's value is the least time of the text's points in it, so two texts
agree in a slot with a probability of their weighted Jaccard similarity.
Points are drawn in ascending time and only up to a bound at which all slots
are full with near certainty (else it is raised), which makes a signature's
cost nearly independent of the text's length.

Signatures are banded.  Texts with the same words are one node.  In each
bucket of a band all nodes are compared with the bucket's least node by their
true multiset overlap; links of at least ``SIMILARITY`` make components.  In
buckets that still hold several components, nodes of different components that
share a band are compared by their bags, block by block inside tasks, the ones
with the most similar signatures first; only links that join components leave
the task.  A large component is put against its outsiders only.  So no link
between components that meet in a band is lost, no pairs are written out, and
no bucket has a size limit.

Texts of under five words are one shingle of all their words; texts without
words are classes of their own each.  Null texts count as empty.  Rows with a
null ``doc_id`` come last in the order that names classes.  Repeated rows fall
into one class.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from .blocks import GROUP_COLUMNS, dealt, sides_of
from .common import WS_CLASS, RollingHash, Texts, mix64, slices, word_bounds, written
from .graph import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
SLOTS = BANDS * ROWS
#: Members of a star that are verified by one task's group, and nodes of a block.
GROUP = 256
#: Bytes of text that a task works on at once; what it holds is about 60 times that.
SLICE = 1 << 20
#: Sets of nodes up to so many are compared as a whole.
LARGE = 16_384
BROADCAST_ROWS = 200_000
SIGN_SCHEMA = "node long, bands array<long>, marks binary"
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch and the text of each, in order."""
    starts, ends, first = word_bounds(t)
    words = mix64(RollingHash(t.buf).of(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    count = np.diff(first)
    text = np.repeat(np.arange(t.n), count)
    out = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            out = out * _A + words[j : j + len(out)]
        keep = text[: len(out)] == text[WORDS - 1 :] if len(out) else np.zeros(0, bool)
        out, of = out[keep], text[: len(keep)][keep]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            extra = [int(np.add.reduce(words[first[i] : first[i + 1]] * _B ** np.arange(1, count[i] + 1, dtype=np.uint64))) for i in short]
            out, of = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return mix64(out), of


def bags(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with the multiplicity: shingles, texts, weights."""
    order = np.lexsort((hashes, of))
    h, d = hashes[order], of[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], d[first], np.diff(np.append(first, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(t: Texts) -> np.ndarray:
    """Times (n, SLOTS) of each text's signature; infinite for texts without words."""
    shingle, of, weight = bags(*shingles(t))
    out = np.full(t.n * SLOTS, np.inf)
    total = np.bincount(of, weight, t.n)
    bound = SLOTS * (np.log(SLOTS) + 5) / np.maximum(total, 1)
    # The processes: interval 0 is (0, 1], interval j is (2**(j-1), 2**j].
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(shingle)), top)
    interval = np.arange(len(at)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(interval > 0, 1 << np.maximum(interval - 1, 0), 0)
    rate = np.maximum(low, 1)
    todo = total > 0
    while todo.any():
        live = todo[of[at]]
        _draw(out, mix64(shingle[at[live]] + interval[live].astype(np.uint64) * _C), of[at[live]], weight[at[live]], low[live], rate[live], bound)
        todo &= np.isinf(out.reshape(t.n, SLOTS)).any(axis=1)
        bound[todo] *= 3  # an empty slot: draw these texts' points further
    return out.reshape(t.n, SLOTS)


def _draw(out: np.ndarray, key: np.ndarray, of: np.ndarray, weight: np.ndarray, low: np.ndarray, rate: np.ndarray, bound: np.ndarray) -> None:
    """Points of the processes in ascending time up to their text's bound."""
    time = np.zeros(len(key))
    with np.errstate(over="ignore"):
        k = np.uint64(1)
        while len(key):
            time = time - np.log(_uniform(mix64(key + k * _A))) / rate
            live = time <= bound[of]
            key, of, weight, low, rate, time = (x[live] for x in (key, of, weight, low, rate, time))
            place = mix64(key + k * _B)
            level = low + 1 + ((place >> np.uint64(33)).astype(np.int64) % rate)
            own = level <= weight
            slot = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % SLOTS
            np.minimum.at(out, of[own] * SLOTS + slot[own], time[own])
            k += np.uint64(1)


def band_hashes(times: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), BANDS, ROWS)
    h = np.zeros((len(times), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix64(h * _A + bits[:, :, r])
    return h.view(np.int64)


def sign_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text): band hashes, and 16 bits of each slot for estimates."""
    for batch in slices(batches, SLICE):
        t = Texts(batch.column("text"))
        times = signatures(t)
        some = np.flatnonzero(~np.isinf(times[:, 0]))
        times = times[some]
        marks = (mix64(np.ascontiguousarray(times).view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
        yield pa.record_batch(
            {
                "node": batch.column("node").take(pa.array(some)),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * BANDS + 1, BANDS), pa.int32()), pa.array(band_hashes(times).reshape(-1))),
                "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
            }
        )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted distinct hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    all_ = int(a[1].sum() + b[1].sum()) - both
    return both / all_ if all_ else 0.0


def verify_rows(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (star, part, node, text), the star's own row before those of its group: links of at least ``least``."""
    star, bag = None, None
    for batch in slices(batches, SLICE):
        t = Texts(batch.column("text"))
        h, of, w = bags(*shingles(t))
        cut = np.searchsorted(of, np.arange(t.n + 1))
        u, v, s = [], [], []
        for i, (own, node) in enumerate(zip(batch.column("star").to_pylist(), batch.column("node").to_pylist())):
            mine = (h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]])
            if node == own:
                star, bag = own, mine
            elif star == own and (sim := overlap(bag, mine)) >= least:
                u.append(node)
                v.append(own)
                s.append(sim)
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "similarity": pa.array(s, pa.float64())})


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v, similarity) of the pairs (node, star) that hold; ``texts``: (node, text) of both.

    A star's group is split into parts, each with the star's text in front, so
    a star of any size is verified by many tasks that each hold two texts.
    """
    parts = pairs.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("n"))
    heads = parts.select("star", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("star").alias("node"))
    members = pairs.join(parts, "star").select("star", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("part"), "node")
    rows = heads.unionByName(members).join(texts, "node").select("star", "part", "node", "text")
    dealt = rows.repartition("star", "part").sortWithinPartitions("star", "part", F.col("node") != F.col("star"))
    return dealt.mapInArrow(lambda b: verify_rows(b, least), "u long, v long, similarity double")


def _expanded(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bag as a sorted set: every shingle once for each of its levels."""
    first = np.repeat(np.cumsum(w) - w, w)
    with np.errstate(over="ignore"):
        return np.sort(mix64(np.repeat(h, w) + (np.arange(len(first)) - first).astype(np.uint64) * _B))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


class _Joined:
    """Which components have been joined within a pair of blocks."""

    def __init__(self) -> None:
        self.lead: dict[int, int] = {}

    def root(self, c: int) -> int:
        while self.lead.get(c, c) != c:
            c = self.lead[c]
        return c


def compare_pair(rows: list[tuple], same_block: bool, least: float) -> list[tuple[int, int, float]]:
    """Links between two blocks that join different components; rows: (left, node, component, bands, marks, text).

    All pairs that share a band are compared by their true bags, those with
    similar signatures first, unless their components are joined already.
    """
    left = [r for r in rows if r[0]]
    right = left if same_block else [r for r in rows if not r[0]]
    if not left or not right:
        return []
    bands, marks = np.stack([r[3] for r in right]), np.stack([r[4] for r in right])
    component = np.array([r[2] for r in right])
    sets: dict[int, np.ndarray] = {}

    def bag(r: tuple) -> np.ndarray:
        if r[1] not in sets:
            h, _, w = bags(*shingles(Texts(pa.array([r[5]]))))
            sets[r[1]] = _expanded(h, w)
        return sets[r[1]]

    pairs = []
    for i, r in enumerate(left):
        may = (component != r[2]) & (bands == r[3]).any(axis=1)
        if same_block:
            may[: i + 1] = False
        pairs += [(-int((marks[j] == r[4]).sum()), i, j) for j in np.flatnonzero(may).tolist()]
    joined, out = _Joined(), []
    for _, i, j in sorted(pairs):
        r, other = left[i], right[j]
        u, v = joined.root(r[2]), joined.root(other[2])
        if u == v:
            continue
        a, b = bag(r), bag(other)
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            continue
        both = _common(a, b)
        sim = both / (len(a) + len(b) - both)
        if sim >= least:
            joined.lead[u] = v
            out.append((r[1], other[1], sim))
    return out


def compare_blocks(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, left, node, component, bands, marks, text), block pair by block pair: the links between components."""

    def linked(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        found = compare_pair(rows, key[1] and key[2] == key[3], least)
        u, v, s = zip(*found) if found else ((), (), ())
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "similarity": pa.array(s, pa.float64())})

    at, rows = None, []
    for batch in slices(batches, SLICE, 256):
        for r in batch.to_pylist():
            key = tuple(r[c] for c in GROUP_COLUMNS)
            if key != at:
                if rows:
                    yield linked(at, rows)
                at, rows = key, []
            rows.append((r["left"], r["node"], r["component"], np.array(r["bands"], np.int64), np.frombuffer(r["marks"], "<u2"), r["text"]))
    if rows:
        yield linked(at, rows)


def _block_links(rest: DataFrame, signed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v, similarity) between different components that meet in a bucket.

    ``rest``: (band, h, node, component) of the buckets that hold several
    components.  Buckets that share nodes are compared as one set of nodes,
    so that a pair which meets in many bands is compared once; a set of over
    ``LARGE`` nodes is compared bucket by bucket instead.  Either way nodes
    are dealt into blocks, and each pair of blocks is a group of its own; a
    component with over ``GROUP`` nodes is compared with its outsiders only.
    """
    rest = written(rest, "rest")
    least_node = rest.groupBy("band", "h").agg(F.min("node").alias("v"))
    sets = components(rest.join(least_node, ["band", "h"]).select(F.col("node").alias("u"), "v"))
    whole = rest.join(sets.withColumnRenamed("component", "key"), "node").select("band", "h", "key", "node", "component")
    size = whole.select("key", "node").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keyed = whole.join(size, "key").withColumn("key", F.when(F.col("n") > LARGE, F.xxhash64("band", "h")).otherwise(F.col("key")))
    # A pair is told from the buckets that it meets in by its bands, so a set of nodes has one row per node.
    rest = keyed.select(F.col("key").alias("token"), "node", "component").distinct()
    rest = rest.join(texts.select("node", (F.octet_length("text") + 500).cast("bigint").alias("bytes")), "node")
    rest = rest.select("token", "node", "component", F.lit(0).cast("bigint").alias("base"), F.lit(True).alias("upper"), "bytes")
    sides, _ = write_frontier(sides_of(rest, GROUP), "sides")
    nodes, n_nodes = write_frontier(sides.select("node").distinct(), "ends")
    own = signed.join(_bounded(nodes, n_nodes), "node", "left_semi").join(texts, "node")
    rows = dealt(sides, GROUP).drop("base", "upper").join(own, "node")
    rows = rows.select(*GROUP_COLUMNS, "left", "node", "component", "bands", "marks", "text")
    groups = rows.repartition(*GROUP_COLUMNS).sortWithinPartitions(*GROUP_COLUMNS)
    return groups.mapInArrow(lambda b: compare_blocks(b, least), "u long, v long, similarity double")


def node_rows(docs: DataFrame, *keep) -> DataFrame:
    """``keep`` and (doc_id, node, text): texts of the same words share a node; null without words."""
    words = F.trim(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), f"[{WS_CLASS}]+", " "))
    rows = docs.select(*keep, docs["doc_id"].cast("long").alias("doc_id"), words.alias("text"))
    return rows.withColumn("node", F.when(F.col("text") != "", F.xxhash64("text")))


def node_classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, int, DataFrame]:
    """(node, component) of the nodes that have links, their number, and the links (u, v, similarity) that were verified."""
    rows = node_rows(docs).where("node is not null")
    # One text per node: the same words, so any will do; copies meet before the shuffle.
    texts = rows.groupBy("node").agg(F.max(F.struct("text")).alias("t")).select("node", "t.text")
    signed = written(texts.mapInArrow(sign_rows, SIGN_SCHEMA), "signed")
    bands = signed.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = bands.groupBy("band", "h").agg(F.min("node").alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets, n_buckets = write_frontier(buckets, "buckets")
    members = written(bands.join(_bounded(buckets, n_buckets), ["band", "h"]), "members")
    wanted, n = write_frontier(members.select("node").distinct(), "candidates")
    near = rows.join(_bounded(wanted, n), "node", "left_semi").groupBy("node").agg(F.max(F.struct("text")).alias("t")).select("node", "t.text")
    near = written(near, "texts")
    pairs = written(members.where("node != star").select("node", "star").distinct(), "pairs")
    links = written(verified(pairs, near, least), "verified")
    found = written(components(links.select("u", "v")), "components")
    labelled = members.join(found, "node", "left").select("band", "h", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("band", "h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("band", "h")
    mixed, n_mixed = write_frontier(mixed, "mixed")
    if n_mixed:
        rest = labelled.join(_bounded(mixed, n_mixed), ["band", "h"], "left_semi")
        further, n_further = write_frontier(_block_links(rest, signed, near, least), "further")
        if n_further:
            links = links.unionByName(further)
            found = written(components(links.select("u", "v")), "components")
    return found, found.count(), links


def _order(doc_id: str = "doc_id"):
    return F.struct(F.col(doc_id).isNull().alias("a"), F.col(doc_id).alias("b"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, n_links), a row per document; a class is named by its first ``doc_id``.

    ``n_links`` counts the links of the document's text that made its class;
    links inside a component that is joined already are not looked for.
    """
    found, n_found, links = node_classes(docs, least)
    rows = written(node_rows(docs).select("doc_id", "node"), "nodes")
    # A pair that meets in several places counts once.
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    tag = written(found.join(degree, "node", "left"), "tags")
    tagged = rows.join(_bounded(tag, n_found), "node", "left").withColumn("class", F.coalesce("component", "node"))
    classes = tagged.where("class is not null").groupBy("class").agg(F.min(_order()).alias("o"), F.count(F.lit(1)).alias("size"))
    classes, n = write_frontier(classes.where("size > 1").select("class", F.col("o.b").alias("first"), "size"), "classes")
    out = tagged.join(_bounded(classes, n), "class", "left")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns: of every class the one with the first ``doc_id`` (of its repeats one)."""
    found, n_found, _ = node_classes(docs, least)
    rows = written(node_rows(docs).where("node is not null").select("doc_id", "node"), "nodes")
    tagged = rows.join(_bounded(found, n_found), "node", "left").withColumn("class", F.coalesce("component", "node"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("node").alias("c"))).alias("o")
    per_node = tagged.groupBy("class", "node", "doc_id").agg(F.count(F.lit(1)).alias("same"))
    classes = per_node.groupBy("class").agg(best, F.sum("same").alias("size"))
    classes = classes.where("size > 1").select("class", F.col("o.b").alias("__first"), F.col("o.c").alias("__lead"))
    marks = per_node.join(classes, "class").select(F.col("node").alias("__node"), "__first", "__lead", F.when((F.col("node") == F.col("__lead")) & F.col("doc_id").eqNullSafe(F.col("__first")), F.col("same")).alias("same"))
    marks = marks.groupBy("__node", "__first", "__lead").agg(F.max("same").alias("__same"))
    marks, n = write_frontier(marks, "marks")
    twins = marks.where("__same > 1").count()
    names = docs.columns
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), docs["doc_id"], docs["text"])
    keyed = node_rows(wide, wide["__row"]).drop("text")
    joined = keyed.join(_bounded(marks, n), keyed["node"] == F.col("__node"), "left")
    kept = joined.where(F.col("__node").isNull() | ((F.col("node") == F.col("__lead")) & F.col("doc_id").eqNullSafe(F.col("__first"))))
    if twins:
        one = kept.where("__same > 1").withColumn("__nr", F.row_number().over(Window.partitionBy("node").orderBy("doc_id"))).where("__nr = 1")
        kept = kept.where("__same is null or __same = 1").select("__row").unionByName(one.select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in names])

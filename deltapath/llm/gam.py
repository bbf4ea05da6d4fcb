"""Quality classifier: an additive model with pairwise interactions.

Every feature is binned at quantiles of the training rows and owns a lookup
table with an entry per bin; a few pairs of features own tables over two
coarser axes.  Training boosts in cycles: in each round every feature (later
every pair) in turn fits a tree of a few leaves to the gradient of the log
loss, and adds it, shrunk, to its table.  A score is the sum of looked-up
entries, added column by column.

One pass over the texts writes a small table of features; training collects
them for at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id.
Rows whose crc32(doc_id as text) mod 3 is 1 are held out of it.

Null texts count as empty and get a score like any other.  A null ``doc_id``
is not held out and has no label.  Several labels of a document are averaged,
null labels left out; without any label all scores are a half.  Repeated rows
get equal scores, empty tables empty results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, Texts, id_text, slices, word_bounds, written

SAMPLE_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, RIDGE = 0.15, 1.0
FEATURES = ("words", "word_length", "upper", "digit", "stop", "symbol", "space", "high", "line_length", "distinct", "stutter", "common", "longest")
FEATURE_SCHEMA = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: small letters and the rest
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>{}[]~^=_@+/\\", " \t\r\x0b\x0c", "\n"), 1):
        kind[[ord(c) for c in chars]] = k
    kind[128:] = 7
    return kind


_KIND = _classes()


def features(t: Texts) -> np.ndarray:
    """(n, len(FEATURES)) of a batch of texts."""
    size = np.diff(t.offs)
    text = np.repeat(np.arange(t.n), size)
    kinds = np.bincount(text * 8 + _KIND[t.buf], minlength=t.n * 8).reshape(t.n, 8)
    n = np.maximum(size, 1)
    starts, ends, first = word_bounds(t)
    words = np.diff(first)
    w = np.maximum(words, 1)
    hashes = RollingHash(t.buf).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    length = ends - starts
    distinct, stutter, common, longest = (np.zeros(t.n) for _ in range(4))
    for i in np.flatnonzero(words):
        h = hashes[first[i] : first[i + 1]]
        _, counts = np.unique(h, return_counts=True)
        distinct[i] = len(counts)
        stutter[i] = np.count_nonzero(h[1:] == h[:-1])
        common[i] = counts.max()
        longest[i] = length[first[i] : first[i + 1]].max()
    total = np.add.reduceat(np.append(length, 0), np.minimum(first[:-1], len(length))) * (words > 0) if t.n else np.zeros(0)
    columns = [np.log1p(words), total / w, kinds[:, 1] / n, kinds[:, 2] / n, kinds[:, 3] / n, kinds[:, 4] / n, kinds[:, 5] / n, kinds[:, 7] / n]
    columns += [np.log1p(size / (kinds[:, 6] + 1)), distinct / w, stutter / w, common / w, np.log1p(longest)]
    return np.stack(columns, axis=1) if t.n else np.zeros((0, len(FEATURES)))


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = features(Texts(batch.column("text")))
        yield pa.record_batch({"doc_id": batch.column("doc_id")} | {f: pa.array(x[:, k]) for k, f in enumerate(FEATURES)})


@dataclass
class Model:
    """``edges[f]`` cut a feature into bins; ``coarse[f]`` into those of the pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.coarse)]
        for (a, b), table in self.pairs.items():
            out += table[rough[a], rough[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _leaf(g: float, h: float) -> float:
    return RATE * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to cut a row of bins in two, with its gain."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over a feature's bins, as values of the bins."""
    parts = [(0, len(g))]
    for _ in range(2):
        found = [(*_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over two axes: one cut of the first, then one of the second on either side."""
    best, chosen = -1.0, []
    for at in range(1, g.shape[0]):
        sides, total = [], 0.0
        for a, b in ((0, at), (at, g.shape[0])):
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            gain, cut = _cut(gs, hs)
            total += gain + float(_gain(gs.sum(), hs.sum()))
            sides.append((a, b, cut))
        if total > best:
            best, chosen = total, sides
    out = np.zeros(g.shape)
    for a, b, cut in chosen:
        for c, d in ((0, cut), (cut, g.shape[1])):
            if d > c:
                out[a:b, c:d] = _leaf(g[a:b, c:d].sum(), h[a:b, c:d].sum())
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables to rows ``x`` with targets ``y`` in [0, 1]."""
    if not len(y):
        return Model()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(base=float(np.log(share / (1 - share))))
    for k in range(x.shape[1]):
        for into, n in ((model.edges, BINS), (model.coarse, COARSE)):
            into.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])))
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = gradient()
            step = _tree(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)))
            table += step
            margin += step[bins[k]]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]
    cell = lambda a, b: rough[a] * shape[b] + rough[b]
    summed = lambda a, b, v: np.bincount(cell(a, b), v, shape[a] * shape[b]).reshape(shape[a], shape[b])
    g, h = gradient()
    strength = {(a, b): float(_gain(summed(a, b, g), summed(a, b, h)).sum()) for a, b in combinations(range(x.shape[1]), 2)}
    chosen = sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]
    model.pairs = {(a, b): np.zeros((shape[a], shape[b])) for a, b in chosen}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            g, h = gradient()
            step = _pair_tree(summed(a, b, g), summed(a, b, h))
            table += step
            margin += step[rough[a], rough[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_rows(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(model.score(x))})


def fit(table: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on features of at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = table.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample_rows).toPandas()  # bounded by the limit
    return train(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    table = written(id_text(docs).mapInArrow(feature_rows, FEATURE_SCHEMA), "features")
    model = fit(table, labels, sample_rows)
    marked = table.withColumn("held_out", held_out(F.col("doc_id")))
    scored = marked.mapInArrow(lambda b: score_rows(b, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

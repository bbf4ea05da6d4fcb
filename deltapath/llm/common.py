"""Helpers that the operators share: reading the tables, scratch tables, batches of texts.

All operators treat ``doc_id`` and ``text`` alike: a null text counts as an
empty one, extra columns are ignored (or passed through by filters), and no
internal column can clash with a column of the input because only the needed
columns are selected and renamed first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of the contracts, ``[\x20\x09-\x0D]``, as a Java/RE2 class body and as bytes.
WS_CLASS = r"\x20\x09-\x0D"
WS_BYTES = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, null texts as empty ones."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared checkpoint folder; read it back.

    The table cuts the lineage: what reads it survives the loss of executors
    without recomputing ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that a task takes.
ROWS_PER_TASK = 50_000


def sized(df: DataFrame, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, which has at most about ``rows`` rows, in no more partitions than these need.

    A shuffle of a small table has as many tasks as one of a large table
    otherwise, nearly all of them empty.  Large tables keep their partitions.
    """
    return df.coalesce(max(1, -(-rows // per_task)))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, f"[{WS_CLASS}]+"), lambda w: w != "")


class Texts:
    """The texts of a batch as one byte buffer with offsets."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + self.n + 1] if offsets else np.zeros(1, np.int64)
        if self.n == 0:
            offs = np.zeros(1, np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        self.buf = whole[offs[0] : offs[-1]]
        self.offs = offs - offs[0]

    def bytes(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``max_bytes`` of buffers (one row at least).

    Bounds what a task holds at once; a single longer text makes its own piece.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        width = np.zeros(n, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                width += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(width), 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + max_bytes, side="right"))
            to = min(max(to, at + 1), at + max_rows, n)
            yield batch.slice(at, to - at)
            at = to


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 step)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += _MIX
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE_KEYS = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        if size > 64 << 20:  # a single giant text: don't keep its table
            return p
        _POWERS[kind] = have = p
    return have


class RollingHash:
    """Hashes of any byte ranges of a buffer, from prefix sums of keyed bytes modulo 2**64."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_KEYS[buf] * _powers("up", _BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = _powers("down", _INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS_BYTES)] = True


def word_bounds(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a batch in its buffer, and for each text the index of its first word (n + 1 entries)."""
    ws = _IS_WS[t.buf]
    edge = np.ones(len(ws) + 1, bool)
    edge[1:-1] = ws[1:] != ws[:-1]
    inner = t.offs[(t.offs > 0) & (t.offs < len(ws))]
    edge[inner] = True  # a text's end also ends a word
    if not len(ws):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(t.n + 1, np.int64)
    at = np.flatnonzero(edge)
    word = ~ws[at[:-1]]
    starts, ends = at[:-1][word], at[1:][word]
    return starts, ends, np.searchsorted(starts, t.offs)

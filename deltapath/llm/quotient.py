"""Exact duplicates through counting quotient filters.

Every task builds a counting quotient filter over the 64-bit fingerprints of
its texts, in segments by the fingerprint's top bits.  A filter keeps runs of
sorted remainders per quotient and holds a fingerprint whole, so filters merge
without loss by merging sorted remainders and adding counts.  Fingerprints
with a count above one route their texts to byte verification: a grouping by
the normalised text itself, partly done before the shuffle, so that a group
of any size leaves a row per map task.

Texts are equal when identical after white space ``[\\x20\\x09-\\x0D]`` is
deleted.  Of equal texts the row with the most code points in the original
text stays, then the smallest ``doc_id``; a null ``doc_id`` comes last.  Null
texts count as empty, all empty texts are equal.  A row that repeats both
``doc_id`` and text of the row that stays is dropped.  Empty tables give empty
results; other columns play no part and pass through the filter as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import write_frontier
from ..session import num_partitions
from .common import WS_CLASS, written

FILTER_SCHEMA = "segment int, filter binary"
COUNT_SCHEMA = "fp long, n long"
#: Rows of (64-character digest, two longs) that may be broadcast: about 12 MB.
BROADCAST_ROWS = 100_000
HOLD = 2_000_000


class QuotientFilter:
    """A counting quotient filter over ``bits``-bit fingerprints with ``2 ** q`` quotients.

    ``occupied`` has a bit per quotient, ``ends`` a bit per slot (last of its
    run), ``slots`` the remainders, ascending in a run.  A count of two is the
    remainder twice; a larger one is a digit between two of the remainder.
    The digit is never the remainder or zero; a zero goes before a digit that
    exceeds the remainder, so a slot below its predecessor always tells a
    counter.  Remainder zero has its own form: 0 0 0 for three, 0 digit 0 0 above.
    """

    def __init__(self, q: int, bits: int) -> None:
        self.q, self.r = np.uint64(q), np.uint64(bits - q)
        self.size = 1 << q

    @staticmethod
    def _counter(x: int, n: int) -> list[int]:
        if n < 3:
            return [x] * n
        if x == 0:
            return [0, 0, 0] if n == 3 else [0, n - 3, 0, 0]
        digit = n - 2
        digit += digit >= x
        return [x, digit, x] if digit < x else [x, 0, digit, x]

    def encode(self, prints: np.ndarray, counts: np.ndarray) -> bytes:
        """``prints``: ascending and distinct."""
        quotient = (prints >> self.r).astype(np.int64)
        rest = prints & ((np.uint64(1) << self.r) - np.uint64(1))
        many = np.flatnonzero(counts > 2)
        coded = {int(i): self._counter(int(rest[i]), int(counts[i])) for i in many}
        width = np.minimum(counts, 2).astype(np.int64)
        width[many] = [len(coded[int(i)]) for i in many]
        slots, at = np.repeat(rest, width), np.cumsum(width) - width
        for i, c in coded.items():
            slots[at[i] : at[i] + len(c)] = np.array(c, np.uint64)
        occupied, ends = np.zeros(self.size, bool), np.zeros(len(slots), bool)
        occupied[quotient] = True
        last = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True)) if len(quotient) else np.zeros(0, np.int64)
        ends[(at + width)[last] - 1] = True
        head = np.array([len(slots)], np.uint64).tobytes()
        return head + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + slots.tobytes()

    def decode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ascending fingerprints and their counts."""
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        a = 8 + -(-self.size // 8)
        b = a + -(-n // 8)
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data[8:a], np.uint8), count=self.size))
        ends = np.unpackbits(np.frombuffer(data[a:b], np.uint8), count=n).astype(bool)
        slots = np.frombuffer(data, np.uint64, n, offset=b)
        run = np.cumsum(ends) - ends
        first = np.append(True, ends[:-1]) if n else ends
        plain = np.ones(n, bool)  # slots in runs that hold no counter
        odd = np.flatnonzero(~first & (slots <= np.append(np.uint64(0), slots[:-1])[:n])) if n else []
        counted = np.unique(run[odd]) if len(odd) else np.zeros(0, np.int64)
        starts = np.flatnonzero(first)
        stops = np.flatnonzero(ends) + 1
        prints, counts = [], []
        for k in counted.tolist():
            a, b = int(starts[k]), int(stops[k])
            plain[a:b] = False
            for x, c in self._run(slots[a:b].tolist()):
                prints.append((int(occupied[k]) << int(self.r)) | x)
                counts.append(c)
        quotient = occupied[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        alone = (quotient[plain] << self.r) | slots[plain]
        prints = np.concatenate([alone, np.array(prints, np.uint64)])
        counts = np.concatenate([np.ones(len(alone), np.int64), np.array(counts, np.int64)])
        order = np.argsort(prints, kind="stable")
        return prints[order], counts[order]

    @staticmethod
    def _run(v: list[int]) -> Iterator[tuple[int, int]]:
        i, n = 0, len(v)
        while i < n:
            x = v[i]
            if x == 0:
                if v[i + 1 : i + 3] == [0, 0]:
                    yield 0, 3
                    i += 3
                elif i + 3 < n and v[i + 2 : i + 4] == [0, 0]:
                    yield 0, v[i + 1] + 3
                    i += 4
                else:
                    c = 2 if v[i + 1 : i + 2] == [0] else 1
                    yield 0, c
                    i += c
            elif i + 1 < n and v[i + 1] < x:
                i += 1 + (v[i + 1] == 0)
                digit = v[i]
                yield x, digit + 2 - (digit > x)
                i += 2
            else:
                c = 2 if v[i + 1 : i + 2] == [x] else 1
                yield x, c
                i += c

    def merge(self, filters: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and counts of all filters, merged by sorted remainders; holds a few of them at a time."""
        held, rows = [], 0
        for data in filters:
            held.append(self.decode(data))
            rows += len(held[-1][0])
            if rows > HOLD:
                held = [added(held)]
                rows = len(held[0][0])
        return added(held)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of all parts with summed counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prints, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prints, kind="stable")  # merges what is sorted already
    prints, counts = prints[order], counts[order]
    if not len(prints):
        return prints, counts
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def build_filters(batches: Iterable[pa.RecordBatch], segment_bits: int, q: int) -> Iterator[pa.RecordBatch]:
    """One filter per segment over the fingerprints of a task (a further one after each HOLD rows)."""
    form, low = QuotientFilter(q, 64 - segment_bits), np.uint64(64 - segment_bits)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        segment = (prints >> low).astype(np.int64) if segment_bits else np.zeros(len(prints), np.int64)
        inner = prints & ((np.uint64(1) << low) - np.uint64(1)) if segment_bits else prints
        cuts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        blobs = [form.encode(inner[a:b], counts[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(prints)))]
        return pa.record_batch({"segment": pa.array(segment[cuts], pa.int32()), "filter": pa.array(blobs, pa.binary())})

    held, rows = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        rows += len(held[-1])
        if rows >= HOLD:
            yield flush(held)
            held, rows = [], 0
    if rows:
        yield flush(held)


def merge_filters(batches: Iterable[pa.RecordBatch], segment_bits: int, q: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints that occur more than once.  The rows of a segment come one after another."""
    form, low = QuotientFilter(q, 64 - segment_bits), np.uint64(64 - segment_bits)
    rows = ((s, f) for b in batches for s, f in zip(b.column("segment").to_pylist(), b.column("filter")))
    ahead = next(rows, None)
    while ahead is not None:
        segment = ahead[0]

        def own() -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == segment:
                yield ahead[1].as_py()
                ahead = next(rows, None)

        prints, counts = form.merge(own())
        if segment_bits:
            prints = prints | (np.uint64(segment) << low)
        many = counts > 1
        yield pa.record_batch({"fp": pa.array(prints[many].view(np.int64)), "n": pa.array(counts[many], pa.int64())})


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of ``prints.fp`` that occur more than once; ``rows``: their number, or near it."""
    parts = num_partitions(prints.sparkSession)
    segment_bits = min(20, max(4, int(np.ceil(np.log2(max(parts, rows / HOLD))))))
    q = min(24, max(3, int(np.log2(max(rows, 1) + 1)) - segment_bits))
    built = prints.select("fp").mapInArrow(lambda b: build_filters(b, segment_bits, q), FILTER_SCHEMA)
    dealt = built.repartition(max(parts, 1 << max(0, segment_bits - 3)), "segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(lambda b: merge_filters(b, segment_bits, q), COUNT_SCHEMA)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; otherwise joins shuffle, and adaptive execution splits hot keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _normal(docs: DataFrame, *columns) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(*columns, docs["doc_id"].cast("long").alias("__id"), F.char_length(text).alias("__cp"), F.regexp_replace(text, f"[{WS_CLASS}]+", "").alias("__norm"))


def duplicate_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """What each row is (doc_id, n_cp, sha, fp), the verified groups of several rows
    (sha, keep_id, group_size, n_same: rows with both the text and the doc_id of the one that stays),
    the number of groups and the number of them with n_same above one."""
    normal = _normal(docs)
    rows, n = write_frontier(normal.select(F.col("__id").alias("doc_id"), F.col("__cp").alias("n_cp"), F.sha2("__norm", 256).alias("sha"), F.xxhash64("__norm").alias("fp")), "prints")
    repeated, n_repeated = write_frontier(repeated_fingerprints(rows, n), "repeated")
    texts = normal.select("__norm", F.xxhash64("__norm").alias("fp")).join(bounded(repeated.select("fp"), n_repeated), "fp", "left_semi")
    same = texts.groupBy("fp", "__norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # bytes compared, not digests
    verified, n_groups = write_frontier(same.select(F.sha2("__norm", 256).alias("sha"), F.col("n").alias("group_size")), "verified")
    order = F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    members = rows.join(bounded(verified, n_groups), "sha").groupBy("sha", "group_size", "doc_id").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n_same"))
    best = members.groupBy("sha", "group_size").agg(F.min(F.struct("o", "n_same")).alias("m"))
    groups = written(best.select("sha", F.col("m.o.c").alias("keep_id"), "group_size", F.col("m.n_same").alias("n_same")), "groups")
    twins = groups.where("n_same > 1").count() if n_groups else 0
    return rows, groups, n_groups, twins


def dedup_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``."""
    rows, groups, n_groups, twins = duplicate_groups(docs)
    found = rows.join(bounded(groups, n_groups), "sha", "left")
    in_group = F.col("group_size").isNotNull()
    out = found.select(
        "doc_id",
        F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~in_group | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.coalesce("n_same", F.lit(1)).alias("__same"),
    )
    if not twins:
        return out.drop("__same")
    again = out.where("kept and __same > 1")
    place = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id"))
    again = again.withColumn("kept", place == 1)
    return out.where("not kept or __same <= 1").unionByName(again).drop("__same")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``dedup_rows`` drops."""
    _, groups, n_groups, twins = duplicate_groups(docs)
    names = docs.columns
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), docs["doc_id"], docs["text"])
    keyed = _normal(wide, wide["__row"]).select("__row", "__id", F.sha2("__norm", 256).alias("__sha"))
    marks = groups.select(F.col("sha").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("n_same").alias("__same"))
    found = keyed.join(bounded(marks, n_groups), "__sha", "left")
    kept = found.where(F.col("__same").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
    if twins:
        one = kept.where("__same > 1").withColumn("__place", F.row_number().over(Window.partitionBy("__sha").orderBy("__id"))).where("__place = 1")
        kept = kept.where("__same is null or __same = 1").select("__row").unionByName(one.select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in names])

"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(LEAST_WORDS,
EXPONENT * q)`` words long, that no neighbouring word extends.  Let ``2**k`` be
the least power of two that is at least q.  The first block of ``2**k`` words
at a multiple of ``2**k`` inside the run is followed or preceded, within the
run and within ``2**k`` words, by its nearest other occurrence, and that lies q
words away: the block is at least a period long, so nearer occurrences would
make a smaller period, and ``EXPONENT`` periods leave room on one side.  So it
is enough to ask for each dyadic block where it occurs next in the window
behind it and in the window before it.

A block's occurrences are a range of the suffix array of the words (its bounds
fall out of the prefix doubling that sorts the suffixes), and the least entry
of such a range above a place is a range successor query of a wavelet tree
over the array.  The occurrences of a block in one window are an arithmetic
progression, its step is the candidate period; the stretch around the block
with this period is then measured word by word, which decides.

All texts of a slice are sorted together (words of different texts are
different symbols); tasks hold a slice, no rows are shuffled.  Null and empty
texts, and texts of white space, have no words and no run.  A single text may
be of any length; it makes a slice of its own.  Repeated rows have a result
each, empty tables give empty results, other columns play no part.  Rows with
a null ``doc_id`` are not altered by the planting of the query.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

LEAST_WORDS = 6
EXPONENT = 4
#: Bytes of text that are sorted together.
SLICE = 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"

Run = tuple[int, int, int]


class WaveletTree:
    """Numbers below ``2**bits``, level by level from the highest bit; zeros of a level go before its ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1 == 1
            packed = np.packbits(np.append(ones, np.zeros(64 - self.n % 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(self.n - int(np.count_nonzero(ones)))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the level in front of a place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & low)

    def below(self, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many entries of each range [first, last) are less than ``bound``."""
        out = np.where(bound >= 1 << self.bits, last - first, 0)
        first, last = first.copy(), np.where(bound >= 1 << self.bits, first, last)
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, last)
            high = (bound >> (self.bits - 1 - level)) & 1 == 1
            out += np.where(high, (last - b) - (first - a), 0)
            first = np.where(high, self.zeros[level] + a, first - a)
            last = np.where(high, self.zeros[level] + b, last - b)
        return out

    def nth(self, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least entry (from 0) of each range."""
        out = np.zeros(len(first), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, first), self._ones(level, last)
            small = (last - b) - (first - a)
            high = n >= small
            out = out << 1 | high
            n = np.where(high, n - small, n)
            first = np.where(high, self.zeros[level] + a, first - a)
            last = np.where(high, self.zeros[level] + b, last - b)
        return out

    def successor(self, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least entry of each range that is at least ``at``, or -1."""
        less = self.below(first, last, at)
        some = less < last - first
        out = np.full(len(first), -1, np.int64)
        out[some] = self.nth(first[some], last[some], less[some])
        return out

    def predecessor(self, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The greatest entry of each range that is less than ``at``, or -1."""
        less = self.below(first, last, at)
        some = less > 0
        out = np.full(len(first), -1, np.int64)
        out[some] = self.nth(first[some], last[some], less[some] - 1)
        return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys; for each key in that order the place where its group starts, and the group's size."""
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    size = np.diff(np.append(starts, len(at)))
    return order, np.repeat(starts, size), np.repeat(size, size)


def suffixes(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and for each k the blocks of ``2**k`` words (place, first, last) that occur again, with their ranges in it.

    ``end``: for each word the place behind its text.  Sorting goes on with
    the suffixes that are not told apart yet.
    """
    n = len(codes)
    order, start, size = _grouped(codes)
    rank, many = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order], many[order] = start, size
    open_ = np.flatnonzero(many > 1)
    blocks, width = [], 1
    while len(open_):
        own = open_[(open_ % width == 0) & (open_ + width <= end[open_])]
        blocks.append((own, rank[own], rank[own] + many[own]))
        behind = open_ + width
        after = np.where(behind < end[open_], rank[np.minimum(behind, n - 1)] + 1, 0)
        order, start, size = _grouped(rank[open_] * (n + 1) + after)
        sorted_ = open_[order]
        old = rank[sorted_]
        # Where a group of the old rank starts among the sorted ones.
        head = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        base = np.repeat(head, np.diff(np.append(head, len(old))))
        rank[sorted_], many[sorted_] = old + start - base, size
        open_ = open_[many[open_] > 1]
        width *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array, blocks


def _stretch(codes: np.ndarray, begin: int, end: int, at: int, q: int) -> tuple[int, int]:
    """The stretch around [at, at + q) in which words q apart are the same."""
    last, step = at + q, 64
    while last < end:
        ahead = codes[last : min(last + step, end)]
        differ = np.flatnonzero(ahead != codes[last - q : last - q + len(ahead)])
        if len(differ):
            last += int(differ[0])
            break
        last, step = last + len(ahead), 2 * step
    first, step = at, 64
    while first > begin:
        low = max(begin, first - step)
        differ = np.flatnonzero(codes[low:first] != codes[low + q : first + q])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, step = low, 2 * step
    return first, last


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> list[list[Run]]:
    """(start, length, period) of all runs of each text, by start, then period; ``codes``: the words as numbers, different in each text."""
    n_texts = len(offsets) - 1
    out: list[list[Run]] = [[] for _ in range(n_texts)]
    if not len(codes):
        return out
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    array, blocks = suffixes(codes, offsets[1:][text])
    tree = WaveletTree(array)
    found: dict[tuple[int, int], int] = {}
    for k, (at, first, last) in enumerate(blocks):
        width = 1 << k
        after, before = tree.successor(first, last, at + 1), tree.predecessor(first, last, at)
        steps = [(at, after - at, after >= 0), (before, at - before, before >= 0)]
        own = np.concatenate([x[ok & (q <= width) & (2 * q > width)] for x, q, ok in steps])
        step = np.concatenate([q[ok & (q <= width) & (2 * q > width)] for _, q, ok in steps])
        order = np.lexsort((own, step))
        reached: tuple[int, int] = (0, 0)
        for a, q in zip(own[order].tolist(), step[order].tolist()):
            if reached[0] == q and a + q <= reached[1]:
                continue  # in the stretch that has been measured
            begin, end = int(offsets[text[a]]), int(offsets[text[a] + 1])
            start, stop = _stretch(codes, begin, end, a, q)
            reached = (q, stop)
            if stop - start >= max(LEAST_WORDS, EXPONENT * q):
                found[start, stop] = min(q, found.get((start, stop), q))
    for (start, stop), q in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
        begin = int(offsets[text[start]])
        out[text[start]].append((start - begin, stop - start, q))
    return out


def left_over(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those in no run, and of each run its first period (unless another run has them behind its own)."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def planted(doc_id: int | None, n: int) -> tuple[int, int]:
    """Where the query's planted repetition starts and its period; the start is n for texts without one."""
    if doc_id is None or not n:
        return n, 1
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return n, 1
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def run_rows(batches: Iterable[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, SLICE):
        ids, texts, parts, offsets = batch.column("doc_id").to_pylist(), [], [], [0]
        numbers = count()
        for doc_id, text in zip(ids, batch.column("text").cast(pa.large_binary())):
            words = text.as_py().split()  # of bytes: at the six characters of the contract
            if plant:
                a, p = planted(doc_id, len(words))
                words[a:] = [words[a + i % p] for i in range(len(words) - a)]
            code: defaultdict[bytes, int] = defaultdict(numbers.__next__)
            parts.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
            texts.append(words)
            offsets.append(offsets[-1] + len(words))
        rows: list[tuple] = []
        for doc_id, words, runs in zip(ids, texts, find_runs(np.concatenate(parts), np.array(offsets))):
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            kept = words
            if runs:
                stays = left_over(len(words), runs)
                kept = [w for w, ok in zip(words, stays.tolist()) if ok]
            rows.append(
                (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
                + (hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
                + (len(words), len(words) - len(kept))
            )
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        kinds = [pa.string() if field.endswith("string") else pa.int64() for field in SCHEMA.split(", ")]
        yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per row of ``docs``: number of runs, the longest run, digests of all runs and of the text without repetitions.

    ``plant`` first writes a repetition into the texts that their ``doc_id``'s CRC-32 picks.
    """
    return id_text(docs).mapInArrow(lambda batches: run_rows(batches, plant), SCHEMA)

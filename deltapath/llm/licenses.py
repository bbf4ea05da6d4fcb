"""License scans by winnowed fingerprints and banded alignment.

Texts are reduced to ASCII letters (small) and digits and bytes beyond ASCII.
Hashes of all runs of ``GRAM`` characters are winnowed: of every ``WINDOW``
neighbours the least is a fingerprint, so a common stretch of ``GRAM + WINDOW
- 1`` characters always shares one.  Of templates of up to ``SHORT``
characters all runs of ``SHORT_GRAM`` are fingerprints, as one edit leaves them
no longer run.  An inverted index holds the templates' fingerprints with their
places; hits of a document on nearby diagonals make a candidate, which a banded
alignment of the whole template decides: reported are the span and the
coverage, the matched characters' share of the template or of the span if that
is longer.  A candidate whose longest common subsequence with the region (by
bit-parallel steps, a bound for any alignment's matches) is too short is not
aligned.

Licenses that differ by a word or a version have nearly the same notices.  A
template's name is given only if its distinguishing words stand in the text
(``DISTINCT``), else the name of its family.  Of overlapping matches the one
with the most matched characters is reported, where a match without its words
counts ``LEAST_COVERAGE`` of its characters.
Null and empty texts have no match; texts of any length are scanned whole;
repeated rows each have their own result; empty tables give empty results and
other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RollingHash, Texts, id_text, slices
from .license_texts import DISTINCT, TEMPLATES

GRAM, WINDOW = 9, 6
SHORT, SHORT_GRAM = 40, 6
LEAST_COVERAGE = 0.8
#: Half width of the band: this and a share of the template's length.
BAND, BAND_SHARE = 8, 0.08
GAP = GRAM + WINDOW
NONE = np.uint64(2**64 - 1)
SCHEMA = "doc_id long, n_matches long, licenses string, spans string, best_coverage double"

_NORMAL = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _NORMAL[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _NORMAL[_c] = _c + 32
_NORMAL[128:] = np.arange(128, 256)


def normal(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal characters of all texts with a gap before and behind each, their byte positions, and each text's first place."""
    chars = _NORMAL[t.buf]
    at = np.flatnonzero(chars)
    text = np.searchsorted(t.offs, at, side="right") - 1
    place = np.arange(len(at)) + GAP * (text + 1)
    out = np.zeros(len(at) + GAP * (t.n + 1), np.uint8)
    out[place] = chars[at]
    origin = np.zeros(len(out), np.int64)
    origin[place] = at
    first = np.searchsorted(at, t.offs[:-1]) + GAP * (np.arange(t.n) + 1)
    return out, origin, first


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over n neighbours from each place on (fewer at the end)."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        moved = out.copy()
        moved[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        out, have = moved, have + step
    return out


def grams(chars: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` characters from each place on; ``NONE`` for those with a gap."""
    at = np.arange(max(0, len(chars) - length + 1))
    if not len(at):
        return np.zeros(0, np.uint64)
    h = np.minimum(RollingHash(chars).of(at, at + length), NONE - np.uint64(1))
    gap = np.append(0, np.cumsum(chars == 0))
    h[gap[length:] != gap[:-length]] = NONE
    return h


def fingerprints(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed fingerprints."""
    h = grams(chars, GRAM)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    least = _sliding(h, WINDOW, np.minimum)
    # A place is chosen if it is the least of some window, that is if it equals the greatest of its windows' minima.
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least])
    chosen = np.flatnonzero((h != NONE) & (h == _sliding(padded, WINDOW, np.maximum)[:n]))
    return chosen, h[chosen]


class Pattern:
    """A template as bit masks: bit i of a character's mask is set if the template's i-th character is this one."""

    def __init__(self, template: np.ndarray) -> None:
        self.n = len(template)
        self.masks = [0] * 256
        for i, c in enumerate(template.tolist()):
            self.masks[c] |= 1 << i

    def common(self, region: bytes) -> int:
        """Length of the longest common subsequence with a region, all template characters in one step per character."""
        full = (1 << self.n) - 1
        rest = full
        for c in region:
            mask = self.masks[c]
            if mask:
                hit = rest & mask
                rest = (rest + hit | rest - hit) & full
        return self.n - rest.bit_count()


def align(template: np.ndarray, region: np.ndarray, band: int) -> tuple[int, int, int]:
    """Banded alignment of the whole template within a region whose character ``band + i`` faces the template's i-th.

    Returns matched characters and the first and last matched place of the
    region (end exclusive).  A match scores 1, a mismatch -1, a gap -1.
    """
    n, width = len(template), 2 * band + 1
    padded = np.concatenate([region, np.zeros(max(0, n + width - len(region)), np.uint8)])
    columns = np.arange(width)
    score, back = np.zeros(width, np.int64), np.zeros((n, width), np.int8)
    for i in range(n):
        same = padded[i : i + width] == template[i]
        diagonal = score + np.where(same, 1, -1)
        up = np.append(score[1:], -(10**9)) - 1
        best = np.maximum(diagonal, up)
        left = np.maximum.accumulate(best + columns) - columns
        back[i] = np.where(left > best, 2, np.where(up > diagonal, 1, 0))
        score = left
    j, i = int(score.argmax()), n - 1
    matched, first, last = 0, 0, 0
    while i >= 0 and 0 <= j < width:
        way = back[i, j]
        if way == 2:
            j -= 1
        elif way == 1:
            i, j = i - 1, j + 1
        else:
            if padded[i + j] == template[i]:
                matched, first, last = matched + 1, i + j, last or i + j + 1
            i -= 1
    return matched, first, last


def distinct(words: str) -> re.Pattern[bytes]:
    """Words one behind the other, whatever stands between them but letters and digits; ``3`` and ``3.0`` are one version, ``3.1`` is another."""

    def one(word: str) -> str:
        if word == "version":
            return "(?:version|ver|v)"
        major, _, minor = word.partition(".")
        if not major.isdigit():
            return re.escape(word)
        return (rf"{major}\.{minor}" if minor.strip("0") else rf"{major}(?:\.0)?") + r"(?![0-9]|\.[0-9]*[1-9])"

    return re.compile(rb"(?<![0-9A-Za-z])" + r"[\W_]*".join(map(one, words.lower().split())).encode(), re.IGNORECASE)


class LicenseIndex:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        given = sorted(templates)
        # Words that a template of this name doesn't hold itself are none of its own.
        words = {name: [distinct(w) for w in DISTINCT[name][0]] for name in given if name in DISTINCT}
        self.words = {k: words[name] for k, name in enumerate(given) if name in words and all(w.search(templates[name].encode()) for w in words[name])}
        families = sorted({DISTINCT[given[k]][1] for k in self.words})
        self.family = {k: len(given) + families.index(DISTINCT[given[k]][1]) for k in self.words}
        self.names = given + families
        self.chars: list[np.ndarray] = []
        self.entries: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, name in enumerate(given):
            chars, _, first = normal(Texts(pa.array([templates[name]])))
            self.chars.append(chars[GAP:-GAP])
            for place, h in zip(*fingerprints(chars)):
                self.entries.setdefault(int(h), []).append((k, int(place) - GAP))
            if len(self.chars[k]) <= SHORT:
                for place, h in enumerate(grams(self.chars[k], SHORT_GRAM)):
                    self.short.setdefault(int(h), []).append((k, place))
        self.patterns = [Pattern(c) for c in self.chars]
        self.keys = np.sort(np.array(list(self.entries), np.uint64))
        self.short_keys = np.sort(np.array(list(self.short), np.uint64))

    def scan(self, t: Texts) -> list[list[tuple[int, int, int, float]]]:
        """(start, end, template, coverage) in bytes of each text, without overlaps, in order."""
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(t.n)]
        if not t.n:
            return out
        chars, origin, first = normal(t)
        hits: dict[tuple[int, int], list[int]] = {}
        runs = grams(chars, SHORT_GRAM)
        for (place, h), keys, entries in ((fingerprints(chars), self.keys, self.entries), ((np.arange(len(runs)), runs), self.short_keys, self.short)):
            if not len(keys):
                continue
            known = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            place, h = place[known], h[known]
            text = np.searchsorted(first, place, side="right") - 1
            for i, p, x in zip(text.tolist(), place.tolist(), h.tolist()):
                for k, at in entries[x]:
                    hits.setdefault((i, k), []).append(p - at)
        found: dict[int, list[tuple[float, int, int, int, float]]] = {}
        for (i, k), diagonals in hits.items():
            begin = int(first[i])
            end = int(first[i + 1]) - GAP if i + 1 < t.n else len(chars) - GAP
            for matched, a, z in self._matches(chars, begin, end, k, sorted(set(diagonals))):
                start = int(origin[a] - t.offs[i])
                stop = int(origin[z - 1] - t.offs[i]) + 1
                share = matched / max(len(self.chars[k]), z - a)
                if self._has_words(k, t.buf[t.offs[i] + start : min(t.offs[i] + stop + 4, t.offs[i + 1])].tobytes(), stop - start):
                    found.setdefault(i, []).append((matched, start, stop, k, share))
                else:
                    found.setdefault(i, []).append((LEAST_COVERAGE * matched, start, stop, self.family[k], share))
        for i, spans in found.items():
            kept: list[tuple[int, int, int, float]] = []
            for _, start, stop, k, share in sorted(spans, key=lambda s: (-s[0], s[1], -s[4], s[3])):
                if all(stop <= a or start >= b for a, b, *_ in kept):
                    kept.append((start, stop, k, share))
            out[i] = sorted(kept)
        return out

    def _has_words(self, k: int, text: bytes, end: int) -> bool:
        """Whether the template's distinguishing words stand in the span of ``end`` bytes; ``text`` goes on a little, for the end of a version."""
        return all(any(m.end() <= end + 2 for m in w.finditer(text)) for w in self.words.get(k, ()))

    def _matches(self, chars: np.ndarray, begin: int, end: int, k: int, diagonals: list[int]) -> Iterator[tuple[int, int, int]]:
        template = self.chars[k]
        n = len(template)
        band = BAND + int(BAND_SHARE * n)
        at = 0
        while at < len(diagonals):
            d = diagonals[at]
            if d >= begin and d + n <= end and np.array_equal(chars[d : d + n], template):
                yield n, d, d + n
                while at < len(diagonals) and diagonals[at] <= d + band:
                    at += 1
                continue
            low = max(begin, d - band)
            own = chars[low : min(end, d + n + band)]
            if self.patterns[k].common(own.tobytes()) >= LEAST_COVERAGE * n:
                region = np.concatenate([np.zeros(low - (d - band), np.uint8), own])
                matched, a, z = align(template, region, band)
                if matched >= LEAST_COVERAGE * max(n, z - a):
                    yield matched, d - band + a, d - band + z
            while at < len(diagonals) and diagonals[at] <= d + band:  # the band has covered these
                at += 1


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> LicenseIndex:
    """Built once in a Python worker."""
    return LicenseIndex(dict(templates))


def scan_rows(batches: Iterable[pa.RecordBatch], templates: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    index = index_of(templates)
    for batch in slices(batches, 4 << 20):
        t = Texts(batch.column("text"))
        licenses, spans, counts, best = [], [], [], []
        for i, found in enumerate(index.scan(t)):
            if found:
                points = np.append(0, np.cumsum((t.buf[t.offs[i] : t.offs[i + 1]] & 0xC0) != 0x80))
                spans.append(",".join(f"{index.names[k]}:{points[a]}:{points[b]}:{share:.4f}" for a, b, k, share in found))
            else:
                spans.append("")
            licenses.append(",".join(sorted({index.names[k] for _, _, k, _ in found})))
            counts.append(len(found))
            best.append(max((s for *_, s in found), default=0.0))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_matches": pa.array(counts, pa.int64()), "licenses": pa.array(licenses, pa.string()), "spans": pa.array(spans, pa.string()), "best_coverage": pa.array(best, pa.float64())})


def scan_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per document with its matches ``name:start:end:coverage`` in code points.  No shuffle."""
    given = tuple(sorted(templates.items()))
    return id_text(docs).mapInArrow(lambda batches: scan_rows(batches, given), SCHEMA)

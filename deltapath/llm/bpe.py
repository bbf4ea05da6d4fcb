"""Byte-level BPE by forced-boundary splitting, and decoding.

A pair of bytes that occurs inside no vocabulary token can never be merged
over, so every place where such a pair stands is a certain cut.  Encoding
therefore goes: added tokens, pre-tokens (the byte-level pattern), fragments
between certain cuts; each distinct fragment is merged on its own, and the ids
are concatenated.  Fragments stay short even in texts without white space.

Odd cases: a null text is an empty one (no ids, empty decoded text); rows
repeat as given; a fragment of any length is merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Texts, id_text, slices

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens and fragments whose ids a task keeps (under 100 MB); beyond it, it starts anew.
MEMO_SIZE = 300_000
SHORT = 24
NONE = np.int32(2**31 - 1)
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, ids array<int>, decoded string"


def byte_alphabet() -> dict[str, int]:
    """Printable characters that stand for bytes in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words aren't handled")
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((self.vocab[a], self.vocab[b]), k)
            self.made.append(self.vocab[a + b])
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.inside = np.zeros((256, 256), bool)
        for t in self.vocab:
            for a, b in zip(t, t[1:]):
                self.inside[a, b] = True
        self.pieces = regex.compile(PATTERN).findall
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.as_text = {i: str(i) for i in self.tokens}
        order = np.argsort(keys := np.array([(a << 32) | b for a, b in self.rank], np.int64))
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int32)[order]
        self.by_piece: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.older: dict[str, bytes] = {}
        self.by_fragment: dict[bytes, bytes] = {}

    def cuts(self, data: bytes) -> list[bytes]:
        """The fragments of ``data`` between its certain cuts."""
        if len(data) < 2:
            return [data]
        b = np.frombuffer(data, np.uint8) if len(data) > SHORT else data
        if isinstance(b, bytes):
            inside, at, out = self.inside, 0, []
            for i in range(1, len(b)):
                if not inside[b[i - 1], b[i]]:
                    out.append(b[at:i])
                    at = i
            return [*out, b[at:]]
        ends = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        return [data[a:z] for a, z in zip([0, *ends], [*ends, len(data)])]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one long fragment: the lowest-ranked pair first, of equal ones the leftmost."""
        ids = [self.single[b] for b in data]
        n, rank, made = len(ids), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made[low], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NONE)

    def _merge_rows(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of many short fragments, one per row of a matrix; each round does the next merge of every row."""
        lens = np.fromiter(map(len, fragments), np.int64, len(fragments))
        width = int(lens.max())
        cols = np.arange(width)
        ids = np.full((len(lens), width + 1), -1, np.int32)
        ids[:, :width][cols < lens[:, None]] = np.array(self.single, np.int32)[np.frombuffer(b"".join(fragments), np.uint8)]
        made, done = np.array(self.made, np.int32), np.full((len(lens), width), -1, np.int32)
        row, ranks = np.arange(len(lens)), self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(1)
            low = ranks[np.arange(len(at)), at]
            live = low < NONE
            done[row[~live]] = ids[~live, :width]
            row, ids, at, low = row[live], ids[live], at[live], low[live]
            if not len(row):
                break
            each = np.arange(len(row))
            ids[each, at] = made[low]
            after = np.minimum(cols + (cols > at[:, None]), width)  # closes the gap behind the merged pair
            ids[:, :width] = np.take_along_axis(ids, after, 1)
            ranks = np.take_along_axis(ranks[live], np.minimum(after, width - 1), 1)
            ranks[each, at] = self._ranks(ids[each, at], ids[each, at + 1])
            left = np.maximum(at - 1, 0)
            ranks[each, left] = self._ranks(ids[each, left], ids[each, left + 1])
        data, ends = done[done >= 0].astype("<u4").tobytes(), (np.cumsum((done >= 0).sum(1)) * 4).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: their fragments' ids in order, each new fragment merged once."""
        parts = [self.cuts(p.encode()) for p in pieces]
        known = self.by_fragment
        if len(known) > MEMO_SIZE:
            known.clear()
        new = {f for part in parts for f in part}.difference(known)
        short = [f for f in new if len(f) <= SHORT]
        ids = dict(zip(short, self._merge_rows(short))) if short else {}
        known.update(ids)
        ids |= {f: np.array(self.merge(f), "<u4").tobytes() for f in new if len(f) > SHORT}
        get = lambda f: known.get(f) or ids[f]
        self.by_piece.update(zip(pieces, (b"".join(map(get, part)) for part in parts)))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts: list[tuple[int, str, bool]] = []  # text, part of it, whether that is an added token
        for i, text in enumerate(texts):
            if self.at_added is None or not any(t in text for t in self.added):
                parts.append((i, text, False))
            else:
                parts += [(i, x, x in self.added) for x in self.at_added.split(text)]
        pieces = [[] if is_added else self.pieces(x) for _, x, is_added in parts]
        if len(self.by_piece) > MEMO_SIZE // 2:  # what wasn't met again since the last time is dropped
            self.older, self.by_piece = self.by_piece, {}
        seen = set().union(*pieces).difference(self.by_piece)
        met = seen.intersection(self.older)
        self.by_piece.update((p, self.older[p]) for p in met)
        if len(seen) > len(met):
            self._learn(list(seen.difference(met)))
        get = self.by_piece.__getitem__
        out: list[list[bytes]] = [[] for _ in texts]
        for (i, x, is_added), own in zip(parts, pieces):
            out[i].append(self.added[x].to_bytes(4, "little") if is_added else b"".join(map(get, own)))
        if sum(map(len, texts)) > 32 << 20:  # a giant text may have made giant pieces
            self.by_piece, self.older = {}, {}
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def coder_of(tokenizer_json: str) -> ForcedBoundaryBPE:
    """Kept between the tasks of a Python worker."""
    return ForcedBoundaryBPE(tokenizer_json)


def _encoded(batches: Iterable[pa.RecordBatch], tokenizer_json: str) -> Iterator[tuple[pa.RecordBatch, list[list[int]], list[str]]]:
    """Each piece of a batch, the ids of its texts, and what they decode to."""
    coder = coder_of(tokenizer_json)
    for batch in slices(batches, 4 << 20):
        texts = Texts(batch.column("text"))
        ids = [x.tolist() for x in coder.encode_many([texts.bytes(i).decode() for i in range(texts.n)])]
        yield batch, ids, [coder.decode(x) for x in ids]


def digest_rows(batches: Iterable[pa.RecordBatch], tokenizer_json: str) -> Iterator[pa.RecordBatch]:
    as_text = coder_of(tokenizer_json).as_text.__getitem__
    for batch, ids, decoded in _encoded(batches, tokenizer_json):
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                "ids_sha256": pa.array([sha256(",".join(map(as_text, x)).encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
        )


def id_rows(batches: Iterable[pa.RecordBatch], tokenizer_json: str) -> Iterator[pa.RecordBatch]:
    for batch, ids, decoded in _encoded(batches, tokenizer_json):
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())})


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document.  No shuffle: each text is read, encoded and decoded in one task."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))  # the vocabulary: a few MB
    return id_text(docs).mapInArrow(lambda batches: id_rows(batches, spec.value), IDS_SCHEMA)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: digests of what ``encode_documents`` returns."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    return id_text(docs).mapInArrow(lambda batches: digest_rows(batches, spec.value), DIGEST_SCHEMA)

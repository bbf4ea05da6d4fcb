"""Token-id output as length-delimited binary records, with an offset index.

``write_records`` encodes each document with a public tokenizer, frames its
ids as one record and writes the records in ascending ``doc_id`` order:

    length   8 bytes, little endian
    masked CRC-32C of the length, 4 bytes
    payload
    masked CRC-32C of the payload, 4 bytes

The payload is ``flags`` (1 byte, bit 0: doc_id is not null), ``width`` (1
byte, bytes an id takes), ``doc_id`` (8 bytes) and the ids.  Ids take two
bytes where the vocabulary allows.  Shard files are written by the tasks of a
range partitioning on ``doc_id``; a file's name holds the task attempt, and
the offset index (a Parquet table beside the files) names only the files of
attempts that succeeded, so retries and lost executors leave no wrong records.

``read_records`` streams whole files and checks both checksums;
``read_shuffled`` reads single records by the index, in a random order.

Nulls and odd cases: a null text is an empty one (its record holds the end id
alone), a null ``doc_id`` sorts first and comes back as null, repeated rows
each get a record, an empty table gives an empty index and no file; very long
texts are one record.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import num_partitions, scratch_path
from .common import WS_BYTES, Texts, id_text, slices
from .crc32c import crc32c_many, masked

HEADER = struct.Struct("<QI")
FOOT = struct.Struct("<I")
PREFIX = struct.Struct("<BBq")
INDEX_SCHEMA = "shard int, file string, seq long, doc_id long, offset long, length long, n_tokens long"
RECORD_SCHEMA = "shard int, file string, seq long, doc_id long, shard_start long, n_tokens long, ids_crc32 long"
#: Distinct words of which a task keeps the ids (about 100 MB).
MEMO_WORDS = 400_000
#: Fixed value: a pattern that takes letters in a row as one match.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters below U+0250 (Latin) that neither NFC nor lower-casing changes.
LOWER = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
ROWS_PER_SHARD = 50_000


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer file splits words by a pattern and drops what lies between them, white space included."""
    pre = spec["pre_tokenizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "\\s" in first["pattern"].get("Regex", "")


def last_ids(spec: dict) -> np.ndarray | None:
    """Whether each id ends a match of the pattern, if the ids tell: every byte has a token with the suffix, and nothing deletes letters."""
    model, suffix, pre = spec["model"], spec["model"].get("end_of_word_suffix"), spec["pre_tokenizer"]
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in steps)
    byte_level = [p["type"] for p in pre.get("pretokenizers") or []] == ["Split", "ByteLevel"]
    if not (suffix and plain and byte_level and model["type"] == "BPE"):
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    if not all(c + suffix in model["vocab"] for c in ByteLevel.alphabet()):
        return None
    out = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
    out[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return out


def keeps_letters(spec: dict) -> bool:
    """Whether a word of ``LOWER`` reaches the model as its bytes, in one piece; asked of files for which ``last_ids`` are known."""
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    return split["pattern"].get("Regex") == LETTER_RUNS and not byte_level["add_prefix_space"] and not byte_level.get("use_regex", True)


class WordEncoder:
    """Ids of whole texts through the tokenizers library, each distinct word encoded once.

    Words are cut at ASCII white space where the tokenizer drops that: neither
    its normaliser nor its pattern looks across, so a text's ids are its
    words' ids in order.  ASCII punctuation behind a letter or digit is a match of its own
    for the pattern too, and letter case is dropped by the normaliser.  Many
    texts are cut, their words told apart and replaced by ids in Arrow; only
    distinct words are looked up.  New words go to the library a few hundred
    at a time, with a mark between them unless they are letters alone and the
    ids tell where a match ends; lower-case Latin ones skip the normaliser and
    the pattern if these leave them as they are.  Other tokenizers get every
    text as it is.
    """

    SPACE, OTHER, ALNUM, TAIL = range(4)
    #: What each byte is: white space, ASCII letter or digit, punctuation that may be cut off a word's end, or else.
    KINDS = bytes(0 if b in WS_BYTES else 2 if bytes([b]).isalnum() else 3 if b in b".,;:!?#$%&*" else 1 for b in range(256))
    MARK = "\x01"

    def __init__(self, tokenizer_json: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(f"<u{width}")
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        spec = json.loads(tokenizer_json)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.by_word = drops_white_space(spec) and len(mark) == 1
        self.mark = mark[0] if self.by_word else -1
        self.lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.last = last_ids(spec) if self.by_word else None
        self.model = None
        if self.last is not None and keeps_letters(spec):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.is_lower = re.compile(f"[{LOWER}]+").fullmatch

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def _keep(self, group: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size, data = self.kind.itemsize, ids.astype(self.kind).tobytes()
        cuts = zip((starts * size).tolist(), (ends * size).tolist(), strict=True)
        self.memo.update(zip(group, [data[a:z] for a, z in cuts], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        memo, mark = self.memo, self.MARK.encode()
        blob = b" ".join(new)
        if mark in blob or any(t in blob for t in self.added):
            odd = [w for w in new if mark in w or any(t in w for t in self.added)]
            memo.update(zip(odd, self._whole(odd)))
            new = [w for w in new if w not in memo]
        plain, letters, others = [], [], [] if self.last is not None else new
        if self.last is not None:
            for w, text in zip(new, b" ".join(new).decode().split(" ")):
                (plain if self.model is not None and self.is_lower(text) else letters if text.isalpha() else others).append(w)
        for tokenizer, words in ((self.model, plain), (self.tokenizer, letters)):
            for group, ids in self._groups(tokenizer, words, " ", ""):
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group):
                    self._keep(group, ids, np.append(0, ends[:-1]), ends)
                else:  # some letters are none to the library
                    others += group
        for group, ids in self._groups(self.tokenizer, others, f" {self.MARK} ", f" {self.MARK}"):
            ends = np.flatnonzero(ids == self.mark)
            self._keep(group, ids, np.append(0, ends[:-1] + 1), ends)

    def _groups(self, tokenizer, words: list[bytes], between: str, behind: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Groups of words and their ids, encoded as one text each."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        texts = [between.encode().join(g).decode() + behind for g in groups]
        for group, got in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            yield group, np.array(got.ids, np.int64)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of these distinct words, kept in the memo; what wasn't met since it was last full is dropped."""
        if len(self.memo) > MEMO_WORDS // 2:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        found = list(map(memo.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        met = list(filter(older.__contains__, new))
        memo.update(zip(met, map(older.__getitem__, met)))
        self._learn(list(filterfalse(older.__contains__, new)) if met else new)
        return [memo[w] if x is None else x for w, x in zip(words, found)] if new else found

    def _lowered(self, data: bytes, ends: np.ndarray) -> bytes:
        """``data`` with A-Z lower-cased, but for the texts that then hold an added token."""
        low = data.lower()  # bytes.lower knows ASCII alone
        if not any(x in low for x in self.added):
            return low
        spans = [(low[a:z], data[a:z]) for a, z in zip([0, *ends], ends)]
        return b"".join(t if any(x in small for x in self.added) else small for small, t in spans)

    def _words(self, data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, tails apart from their words, and how many stand before each text's start and the end."""
        kind = np.frombuffer(data.translate(self.KINDS), np.uint8)
        keep = kind != self.SPACE
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        begins = offsets[offsets < len(keep)]
        first[begins] = keep[begins]
        last = keep.copy()
        last[:-1] &= ~keep[1:] | first[1:]
        starts, lasts = np.flatnonzero(first), np.flatnonzero(last)
        spaces = starts - np.cumsum(np.append(0, lasts - starts + 1))[:-1]  # before each word
        ends_so = kind[lasts] == self.TAIL
        at, start, gone = lasts[ends_so], starts[ends_so], spaces[ends_so]
        for _ in range(8):  # words with longer tails stay whole
            at = at - ((at > start) & (kind[at - 1] == self.TAIL))
        cut = (at > start) & (kind[at - 1] == self.ALNUM)
        where = np.searchsorted(starts, at[cut])
        starts, spaces = np.insert(starts, where, at[cut]), np.insert(spaces, where, gone[cut])
        letters = data.translate(None, WS_BYTES)
        bounds = np.append(starts - spaces, len(letters))
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]), np.searchsorted(starts, offsets)

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column without nulls."""
        texts = Texts(column)
        if not self.by_word:
            return self._whole([texts.bytes(i) for i in range(texts.n)])
        data = texts.buf.tobytes()
        if self.lowers:
            data = self._lowered(data, texts.offs[1:].tolist())
        words, before = self._words(data, texts.offs)
        if not len(words):
            return [b""] * texts.n
        coded = words.dictionary_encode()
        del data, words
        ids = pa.array(self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[before].tolist()
        view = memoryview(data if data is not None else b"")
        return [bytes(view[a:z]) for a, z in zip(at, at[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str, width: int) -> WordEncoder:
    """Kept between the tasks of a Python worker."""
    return WordEncoder(tokenizer_json, width)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style path (``file:/x``, ``hdfs://...``, ``s3://...``) and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The payloads with lengths and masked checksums around them."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c_many(lengths)), masked(crc32c_many(payloads))
    return [b"".join((a, FOOT.pack(h), p, FOOT.pack(t))) for a, h, p, t in zip(lengths, heads.tolist(), payloads, tails.tolist())]


def write_shard(batches: Iterable[pa.RecordBatch], out_dir: str, tokenizer_json: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Write the rows of one task as one file; return their index rows."""
    ctx = TaskContext.get()
    shard, attempt = ctx.partitionId(), ctx.taskAttemptId()
    name = f"part-{shard:05d}-{attempt}.rec"
    encoder, end = encoder_of(tokenizer_json, width), np.array([end_id], f"<u{width}").tobytes()
    sink, at, seq = None, 0, 0
    for batch in slices(batches):
        if sink is None:
            fs, folder = open_fs(out_dir)
            sink = fs.open_output_stream(f"{folder}/{name}")
        bodies = [b + end for b in encoder.encode_column(batch.column("text"))]
        ids = batch.column("doc_id").to_pylist()
        records = frame([PREFIX.pack(i is not None, width, i or 0) + b for i, b in zip(ids, bodies)])
        sizes = np.fromiter(map(len, records), np.int64, len(records))
        sink.write(b"".join(records))
        n = len(records)
        yield pa.record_batch(
            {
                "shard": pa.array(np.full(n, shard, np.int32)),
                "file": pa.array([name] * n),
                "seq": pa.array(np.arange(seq, seq + n)),
                "doc_id": batch.column("doc_id"),
                "offset": pa.array(at + np.cumsum(sizes) - sizes),
                "length": pa.array(sizes),
                "n_tokens": pa.array([len(b) // width for b in bodies], pa.int64()),
            }
        )
        at, seq = at + int(sizes.sum()), seq + n
    if sink is not None:
        sink.close()


def write_records(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 1, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Write all documents' ids below ``out_dir``; return the offset index, read back from ``out_dir/index``."""
    spark = docs.sparkSession
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    spec = json.loads(tokenizer_json)
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    width = 2 if top < 1 << 16 else 4
    fs, folder = open_fs(out_dir)
    fs.create_dir(folder, recursive=True)
    shards = max(num_partitions(spark), -(-docs.count() // rows_per_shard))
    ordered = id_text(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # the vocabulary: a few MB

    def write(batches):
        return write_shard(batches, out_dir, tokenizer.value, width, end_id)

    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{out_dir}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, width, doc_id = PREFIX.unpack_from(payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, f"<u{width}", offset=PREFIX.size)


def _checked(heads: list[bytes], payloads: list[bytes], sums: list[tuple[int, int]], where: str) -> None:
    for got, want in ((masked(crc32c_many(heads)), [a for a, _ in sums]), (masked(crc32c_many(payloads)), [b for _, b in sums])):
        if got.tolist() != want:
            raise ValueError(f"checksum mismatch in {where}")


def stream_records(file, where: str, hold: int = 8 << 20) -> Iterator[list[bytes]]:
    """Payloads of a record file from its start, checked, in groups of about ``hold`` bytes."""
    heads, payloads, sums, held = [], [], [], 0
    while True:
        head = file.read(HEADER.size)
        if not head:
            break
        if len(head) < HEADER.size:
            raise ValueError(f"cut-off record in {where}")
        length, head_sum = HEADER.unpack(head)
        if length > hold and int(masked(crc32c_many([head[:8]]))[0]) != head_sum:
            raise ValueError(f"checksum mismatch in {where}")  # before memory is taken for it
        body = file.read(length + FOOT.size)
        if len(body) < length + FOOT.size:
            raise ValueError(f"cut-off record in {where}")
        heads.append(head[:8])
        payloads.append(body[:length])
        sums.append((head_sum, FOOT.unpack_from(body, length)[0]))
        held += length
        if held >= hold:
            _checked(heads, payloads, sums, where)
            yield payloads
            heads, payloads, sums, held = [], [], [], 0
    if payloads:
        _checked(heads, payloads, sums, where)
        yield payloads


def read_files(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    """Rows (shard, file): the records of each file."""
    for batch in batches:
        for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist()):
            fs, folder = open_fs(out_dir)
            start, seq = 0, 0
            with fs.open_input_stream(f"{folder}/{name}", buffer_size=1 << 20) as file:
                for payloads in stream_records(file, name):
                    parsed = [parse_payload(p) for p in payloads]
                    n = np.fromiter((len(x) for _, x in parsed), np.int64, len(parsed))
                    yield pa.record_batch(
                        {
                            "shard": pa.array([shard] * len(n), pa.int32()),
                            "file": pa.array([name] * len(n)),
                            "seq": pa.array(np.arange(seq, seq + len(n))),
                            "doc_id": pa.array([i for i, _ in parsed], pa.int64()),
                            "shard_start": pa.array(start + np.cumsum(n) - n),
                            "n_tokens": pa.array(n),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in parsed], pa.int64()),
                        }
                    )
                    start, seq = start + int(n.sum()), seq + len(n)


def read_records(index: DataFrame, out_dir: str) -> DataFrame:
    """Every record of the files that the index names: its ids' place in the whole corpus, count and crc32.

    ``start`` counts the ids of all records before it.  The totals of the
    shards (one row each) are summed up over the shard number, which follows
    ``doc_id``; records themselves are never ordered again.
    """
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    spread = files.select("shard", "file").repartition(num_partitions(index.sparkSession), "shard")
    records = spread.mapInArrow(lambda batches: read_files(batches, out_dir), RECORD_SCHEMA)
    return records.join(F.broadcast(bases), "shard").select(
        "doc_id",
        (F.col("__base") + F.col("shard_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
        "seq",
    )


def fetch_records(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    """Rows (file, offset, length): the record at each offset."""
    fs, folder = open_fs(out_dir)
    files: dict[str, pa.NativeFile] = {}
    for batch in slices(batches, max_rows=256):
        ids, rows = [], []
        for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if name not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[name] = fs.open_input_file(f"{folder}/{name}")
            data = files[name].read_at(length, offset)
            size, head_sum = HEADER.unpack_from(data)
            payload = data[HEADER.size : HEADER.size + size]
            _checked([data[:8]], [payload], [(head_sum, FOOT.unpack_from(data, HEADER.size + size)[0])], name)
            doc_id, got = parse_payload(payload)
            ids.append(doc_id)
            rows.append(got.astype(np.int64))
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int64()))})
    for f in files.values():
        f.close()


def read_shuffled(index: DataFrame, out_dir: str, seed: int = 0) -> DataFrame:
    """(doc_id, ids) of all records in a random order: the index rows are shuffled, each record is fetched by its offset."""
    key = F.xxhash64("file", "offset", F.lit(seed))
    return index.repartitionByRange(key).sortWithinPartitions(key).select("file", "offset", "length").mapInArrow(lambda batches: fetch_records(batches, out_dir), "doc_id long, ids array<long>")


def op1(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    out_dir = scratch_path(spark, "records")
    index = write_records(docs, tokenizer_path, out_dir)
    return read_records(index, out_dir)

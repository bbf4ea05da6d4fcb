"""Records and byte-level BPE against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from llm_rows import docs, none, odd, odd_rows, texts_of  # noqa: F401
from tokenizers import Tokenizer

from deltapath.llm import bpe, records
from deltapath.llm.crc32c import crc32c_many, masked
from deltapath.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def expected_records(texts):
    t = Tokenizer.from_file(WORD)
    start, out = 0, []
    for doc_id, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_crc32c_known_values():
    assert crc32c_many([b"123456789", b"", b"a", b"\0" * 32]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]
    assert masked(crc32c_many([b"123456789"]))[0] == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) % (1 << 32)


def test_crc32c_is_the_same_for_any_split_into_lanes():
    r = random.Random(1)
    long = bytes(r.randrange(256) for _ in range(5000))
    alone = [int(crc32c_many([long[:n]])[0]) for n in (3, 4, 511, 512, 513, 5000)]
    assert crc32c_many([long[:n] for n in (3, 4, 511, 512, 513, 5000)]).tolist() == alone


def test_records_equal_whole_text_encoding(spark, docs):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.op1(spark, docs, WORD).collect()]
    assert sorted(got) == expected_records(sorted(texts_of(docs).items()))


def test_records_of_odd_rows_and_shuffled_reads(spark, odd, none):
    out = scratch_path(spark, "rec")
    index = records.write_records(odd, WORD, out)
    rows = records.read_records(index, out).collect()
    assert len(rows) == len(odd_rows())
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows][0] is None and [r.doc_id for r in rows][1:] == sorted(r[0] for r in odd_rows() if r[0] is not None)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    t = Tokenizer.from_file(WORD)
    want = sorted((r[0] or -1, t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_rows())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in records.read_shuffled(index, out, 3).collect()) == want
    assert records.op1(spark, none, WORD).collect() == []


def test_damaged_record_is_found(tmp_path):
    data = bytearray(records.frame([b"first payload", b"second payload"])[0])
    data[14] ^= 1
    with pytest.raises(ValueError):
        import io

        list(records.stream_records(io.BytesIO(bytes(data)), "x"))


def test_word_encoder_on_random_texts():
    r = random.Random(2)
    texts = ["".join(r.choice("aAbBsStT'’.,!#<|> \n\t1é٣́İΣ　漢\x01\x1c") for _ in range(r.randrange(40))) for _ in range(2000)]
    encoder = records.WordEncoder(open(WORD).read(), 2)
    given = [t.encode() for t in texts]
    assert encoder.by_word and encoder.encode(given) == encoder._whole(given)


def test_words_of_letters_are_learned_without_marks():
    encoder = records.WordEncoder(open(WORD).read(), 2)
    library, sent = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Seen()
    r = random.Random(4)
    words = sorted({"".join(r.choice("abehinorstéßüñ漢ıςǆ") for _ in range(r.randrange(1, 14))) for _ in range(1500)})
    given = [" ".join(words[i : i + 40]).encode() for i in range(0, len(words), 40)]
    got = encoder.encode(given)
    assert sent and not any(encoder.MARK in t for t in sent)
    assert got == encoder._whole(given)


def test_letters_that_are_none_to_the_library_are_marked():
    encoder = records.WordEncoder(open(WORD).read(), 2)
    encoder.last[:] = False  # as if no word's end were known
    given = [b"stone river, walk", "grün Straße".encode()]
    assert encoder.encode(given) == encoder._whole(given)


def test_lower_case_latin_words_skip_the_normaliser():
    encoder = records.WordEncoder(open(WORD).read(), 2)
    full, sent = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return full.encode_batch_fast(texts, **options)

    encoder.tokenizer = Seen()
    letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower()]
    words = sorted({w for c in letters for w in (c, "ston" + c, c + "ing", c + c, *(c + d for d in letters[::9]))})
    given = [" ".join(words[i : i + 50]).encode() for i in range(0, len(words), 50)]
    got = encoder.encode(given)
    assert sent == []
    assert got == encoder._whole(given)


def test_a_word_of_many_texts_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    encoder = records.WordEncoder(open(WORD).read(), 2)
    encoder.memo = Counted()
    given = [b"Stone river, walk " * 500] * 20
    assert encoder.encode(given) == encoder._whole(given)
    assert Counted.asked < 50


def test_words_at_the_ends_of_texts_and_with_tails():
    given = ["", " ", "stone", "river", ",", "a,", ",b", "c", "walk.,;: ", "\twalk" + "!" * 20, "!" * 30, "x_!", "it's!", "5,5,", "é,", "Wa\x01lk.", "<|EndOfText|>, Stone", "ab<|endoftext|>Cd, RIVER,", "\x0b\x0c", "end"]
    r = random.Random(5)
    given += ["".join(r.choice(["Stone", "é", "ß", "walk", "7", ",", "!", "#", "_", "'s", " ", "\n", "<|endoftext|>", " ", "ﬁ", "\x01"]) for _ in range(r.randrange(25))) for _ in range(1500)]
    encoder, t = records.WordEncoder(open(WORD).read(), 2), Tokenizer.from_file(WORD)
    want = [t.encode(x, add_special_tokens=False).ids for x in given]
    ids = lambda got: [list(struct.unpack(f"<{len(x) // 2}H", x)) for x in got]
    assert ids(encoder.encode([x.encode() for x in given])) == want
    for kind in (pa.string(), pa.large_string()):
        assert ids(encoder.encode_column(pa.array(given, kind).slice(3, 700))) == want[3:703]
    assert encoder.encode([]) == [] and encoder.encode(["\u3000".encode(), b""]) == [b"", b""]


def test_ids_are_the_same_after_words_are_dropped(monkeypatch):
    monkeypatch.setattr(records, "MEMO_WORDS", 40)
    encoder, r = records.WordEncoder(open(WORD).read(), 2), random.Random(6)
    for _ in range(30):
        given = [" ".join(r.choice("abcdefgé") * r.randrange(1, 9) + r.choice(["", ",", "."]) for _ in range(12)).encode() for _ in range(4)]
        assert encoder.encode(given) == encoder._whole(given)
    assert encoder.older


def test_bpe_equals_the_library():
    t, coder = Tokenizer.from_file(BYTE), bpe.ForcedBoundaryBPE(open(BYTE).read())
    r = random.Random(3)
    texts = ["", "a" * 3000, "abc<|endoftext|>def", "it's 'sit can't''s \n\n 's", "日本語🙂 é", "x" * 90 + "é" * 300]
    texts += ["".join(r.choice("ab' st\n\t1é٣! 　漢\x1c\x85") for _ in range(r.randrange(30))) for _ in range(1500)]
    for text, ids in zip(texts, coder.encode_many(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert coder.decode(want) == t.decode(want, skip_special_tokens=False)


def test_forced_boundaries_are_never_inside_a_token():
    coder = bpe.ForcedBoundaryBPE(open(BYTE).read())
    for token in list(coder.vocab)[::7]:
        assert coder.cuts(token) == [token]
    assert b"".join(coder.cuts("né日本\n".encode())) == "né日本\n".encode()


def test_bpe_query_rows(spark, docs, odd, none):
    t = Tokenizer.from_file(BYTE)
    for df, rows in ((docs, list(texts_of(docs).items())), (odd, [(r[0], r[1] or "") for r in odd_rows()])):
        got = sorted(((r.doc_id or -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, BYTE).collect())
        want = []
        for doc_id, text in rows:
            ids = t.encode(text, add_special_tokens=False).ids
            want.append((doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode_documents(none, BYTE).collect() == []

"""Rows that the tests share."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, size long, __row string, h long"
DOCS = "/root/testdata/sf0.001/documents.parquet"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("the of and to a in is that for it was on stone river walk light green paper under seven".split()) + r.choice(["", "", "er", "s", "ing"]) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows; the schema has columns that clash with the operators' own names."""
    long_text = prose(1, 30_000)
    base = prose(2, 120)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # copy
        (3, base.replace(" ", "  "), "en", "b", 1),  # copy with more code points
        (4, base + " and one more", "en", "b", 1),  # near copy
        (5, None, "en", "a", None),
        (6, "", None, None, 0),
        (7, " \n\t ", "de", "c", 4),
        (8, long_text, "en", None, 5),
        (9, "x" * 50_000, "fr", "a", 6),
        (10, "la la la " * 200, "fr", "a", 6),
        (None, prose(3, 80), None, "c", None),
        (11, prose(4, 90) + "\nLicensed under CC BY-NC 4.0.\ntoken = abcdefabcdef1234", "en", "c", 7),
        (11, prose(4, 90) + "\nLicensed under CC BY-NC 4.0.\ntoken = abcdefabcdef1234", "en", "c", 7),  # repeated row
        (12, "né 日本 🙂 <|endoftext|> it's \x00 ok", "xx", "ü", 9),
        (13, "one two three", "en", "c", 3),
    ]
    return [(*r, 0.5, 7, 3, "row", 1) for r in rows]


def texts_of(df) -> dict:
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark):
    return spark.read.parquet(DOCS)

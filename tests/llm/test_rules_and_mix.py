"""Quality rules, mixing and the classifier against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from llm_rows import SCHEMA, docs, none, odd, odd_rows, prose, texts_of  # noqa: F401

from deltapath.llm import gam, mixing, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_counts(spark, docs, odd, none):
    texts = texts_of(docs)
    got = quality_rules.judge(docs).collect()
    assert {r.doc_id: columns(r) for r in got} == {i: base(t) for i, t in texts.items()}
    assert all(not r.kept for r in got if r.base_failed)
    rows = quality_rules.judge(odd).collect()
    assert Counter((r.doc_id, *columns(r)) for r in rows) == Counter((r[0], *base(r[1])) for r in odd_rows())
    assert quality_rules.judge(none).collect() == []


def test_junk_is_rejected_and_prose_is_kept(spark):
    good = [(i, prose(i, 300), "en") for i in range(30)]
    shouted = [(100 + i, prose(50 + i, 300).upper(), "en") for i in range(3)]
    marked = [(200 + i, "### ".join(prose(60 + i, 300).split()), "en") for i in range(3)]
    short = [(300, "ABC ### " * 60, "en")]  # fails by repetition, not by divergence
    guarded = [(400, " ".join(f"Q{i}#" for i in range(55)), "xx")]  # the only document of its language
    rows = good + shouted + marked + short + guarded
    df = spark.createDataFrame([(i, t, lang, "a", 1, 0.5, 7, 3, "row", 1) for i, t, lang in rows], SCHEMA)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 400]


def test_texts_without_common_words_are_rejected_by_words_alone(spark):
    common = [w for w in quality_rules.COMMON_WORDS["en"] if len(w) > 1]
    plain = "stone river walk light green paper under seven".split()

    def text(seed, words, share):
        r = random.Random(seed)
        return " ".join(r.choice(common) if r.random() < share else r.choice(plain) + r.choice(["", "er", "ing"]) for _ in range(words))

    good = [(i, text(i, 80 + 40 * (i % 10), 0.4)) for i in range(40)]
    salad = [(100 + n, text(n, n, 0.0)) for n in (100, 200, 300, 500)]
    german = "stein weg der die und licht mit haus auf garten ist im dem nicht wald ein wasser".split()
    foreign = [(1000 + n, " ".join(random.Random(n + i).choice(german) for i in range(n))) for n in (100, 300)]
    df = spark.createDataFrame([(i, t, "en", "a", 1, 0.5, 7, 3, "row", 1) for i, t in good + salad + foreign], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    bad = [i for i, _ in salad + foreign]
    assert not any(got[i].base_failed for i in bad)
    assert all(got[i].char_distance <= quality_rules.CHAR_DISTANCE for i in bad)  # not for their characters
    assert sorted(i for i, r in got.items() if r.kept) == list(range(40))


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = [3, 1, 0, 4], [0.1, 0.4, 0.5, 0.0]
    a = np.array(p) / 8
    m = (a + np.array(q)) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.lit(8), F.array(*map(F.lit, q))).alias("d")).first().d
    assert abs(got - math.sqrt((kl(a) + kl(q)) / 2)) < 1e-9


def test_keep_good_equals_judge(spark, docs, odd):
    for df in (docs, odd):
        want = sorted(((r.doc_id or -1) for r in quality_rules.judge(df).where("kept").collect()))
        assert sorted((r.doc_id or -1) for r in quality_rules.keep_good(df).collect()) == want


def test_targets():
    got = mixing.targets([("a", 100), ("b", 1000), (None, 900), ("c", 10)])
    # Weights a 5, b 2, c 1, null 5; all but b stop at twice their size, b gets what is left.
    assert got == {"a": 200, "c": 20, None: 1800, "b": 1.5 * 2010 - 2020}
    even = mixing.targets([("a", 1000), ("b", 1000), ("c", 1000)])
    assert even["a"] == 2000 and abs(even["b"] - 2500 * 2 / 3) < 1e-9 and abs(even["c"] - 2500 / 3) < 1e-9
    assert mixing.targets([]) == {}


def check_mix(rows, texts):
    size = {k: len(re.findall(WORD, t)) for k, t in texts.items()}
    taken, total, goal, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        total[r.source] += r.size
        goal[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(r.source_size == total[r.source] for r in rows)
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    assert abs(sum(goal.values()) - 1.5 * sum(total.values())) < 1e-6 * max(1, sum(total.values()))
    return size


def test_mix(spark, docs, odd, none, monkeypatch):
    rows = mixing.mix(docs).collect()
    size = check_mix(rows, texts_of(docs))
    assert {r.doc_id: r.size for r in rows} == size
    monkeypatch.setattr(mixing, "SMALL_BIN", 0)  # cut the bins as far as they go
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert len(mixing.mix(odd).collect()) == len(odd_rows())
    assert mixing.mix(none).collect() == []


def test_take_mix_repeats_rows_as_the_mix_says(spark, docs, odd, none):
    for df in (docs, odd):
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id] += r.copies
        got = mixing.take_mix(df)
        assert got.columns == df.columns
        assert Counter(r.doc_id for r in got.collect()) == +want
    assert mixing.take_mix(none).collect() == []


def test_boundary_follows_the_key(spark, docs):
    """Within a source, documents taken once more than others are those with the least keys."""
    measured = {r.doc_id: r.key for r in mixing.with_measures(docs, mixing.SEED).collect()}
    by_source = defaultdict(list)
    for r in mixing.mix(docs).collect():
        if r.size:
            by_source[r.source].append((measured[r.doc_id], r.copies))
    for rows in by_source.values():
        copies = [c for _, c in sorted(rows)]
        assert copies == sorted(copies, reverse=True)


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    df, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = gam.score_documents(df, labels).collect()
    known = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert len(judged) > 50 and np.mean([a == b for a, b in judged]) >= 0.95


def test_classifier_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.9


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0), (9, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = gam.score_documents(odd, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    unlabelled = gam.score_documents(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert gam.score_documents(none, labels).collect() == []

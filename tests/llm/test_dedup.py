"""Exact and near duplicates and boilerplate lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_rows import SCHEMA, docs, none, odd, odd_rows, prose, texts_of  # noqa: F401

from deltapath.llm import bagminhash, graph, line_dedup, quotient
from deltapath.llm.common import Texts
from deltapath.llm.graph import components
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def exact_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(WS, "", text or "")].append((-len(text or ""), order(doc_id), doc_id))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def check_exact(got, rows):
    groups = exact_groups(rows)
    want = Counter()
    for doc_id, text in rows:
        norm = re.sub(WS, "", text or "")
        keep, n = groups[norm]
        want[(doc_id, keep, n, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup(spark, docs, odd, none):
    check_exact(quotient.dedup_rows(docs).collect(), list(texts_of(docs).items()))
    rows = [(r[0], r[1]) for r in odd_rows()]
    check_exact(quotient.dedup_rows(odd).collect(), rows)
    kept = quotient.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(order(r.doc_id) for r in kept.collect()) == sorted(order(k) for k, _ in exact_groups(rows).values())
    assert quotient.dedup_rows(none).collect() == [] and quotient.drop_duplicates(none).collect() == []


def test_quotient_filter_holds_fingerprints_whole_and_merges():
    r = np.random.default_rng(1)
    form = quotient.QuotientFilter(5, 60)
    parts = []
    for _ in range(6):
        values = np.concatenate([r.integers(0, 1 << 60, 300).astype(np.uint64), (r.integers(0, 32, 200).astype(np.uint64) << np.uint64(55)) + r.integers(0, 4, 200).astype(np.uint64)])
        prints, counts = np.unique(values, return_counts=True)
        counts = counts * r.integers(1, 5, len(counts)) ** 3
        data = form.encode(prints, counts)
        back = form.decode(data)
        assert (back[0] == prints).all() and (back[1] == counts).all()
        parts.append((data, prints, counts))
    want = Counter()
    for _, prints, counts in parts:
        want.update(dict(zip(prints.tolist(), counts.tolist())))
    prints, counts = form.merge(p[0] for p in parts)
    assert dict(zip(prints.tolist(), counts.tolist())) == dict(want) and (np.diff(prints.astype(object)) > 0).all()
    empty = form.encode(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert len(form.decode(empty)[0]) == 0


def bag(text):
    w = [x for x in re.split(WS, text or "") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both, all_ = sum((a & b).values()), sum((a | b).values())
    return both / all_ if all_ else 0.0


def near_classes(rows):
    """Class of each row by all pairs."""
    bags = [bag(t) for _, t in rows]
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                lead[root(i)] = root(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[root(i)].append(order(doc_id) + (doc_id,))
    return Counter((doc_id, min(members[root(i)])[2], len(members[root(i)])) for i, (doc_id, _) in enumerate(rows)), members


def check_near(df, rows):
    want, members = near_classes(rows)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in bagminhash.near_duplicates(df).collect()) == want
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(order(r.doc_id) for r in kept.collect()) == sorted(min(m)[:2] for m in members.values())


def test_near_duplicates(spark, docs, odd, none):
    check_near(docs, list(texts_of(docs).items()))
    check_near(odd, [(r[0], r[1]) for r in odd_rows()])
    assert bagminhash.near_duplicates(none).collect() == [] and bagminhash.keep_one(none).collect() == []


def test_near_duplicates_in_one_large_group(spark):
    """A chain of texts: neighbours are similar, the ends are not, and the least node is not similar to all."""
    base = prose(9, 200).split()
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(k):
            words[(j * 7) % 200] = f"w{j}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, prose(20 + k, 150)) for k in range(5)]
    df = spark.createDataFrame([(i, t, "en", "a", 1, 0.5, 7, 3, "row", 1) for i, t in rows], SCHEMA)
    check_near(df, rows)


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    # Chains whose members miss the star, in small blocks; with and without sets that are too large to be compared as a whole.
    r = random.Random(12)
    rows, base = [], [r.choice("abcdefgh") + str(r.randrange(200)) for _ in range(160)]
    for _ in range(70):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(160)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(w))
    chain = list(base)
    for _ in range(30):
        chain = list(chain)
        chain[r.randrange(160)] = f"y{r.randrange(10**6)}"
        chain[r.randrange(160)] = f"y{r.randrange(10**6)}"
        rows.append(" ".join(chain))
    rows += [" ".join(r.choice("abcdefgh") + str(r.randrange(200)) for _ in range(40)) for _ in range(20)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bagminhash, "GROUP", 8)
    want, _ = near_classes(rows)
    for large in (10**6, 5):
        monkeypatch.setattr(bagminhash, "LARGE", large)
        assert Counter((x.doc_id, x.class_id, x.class_size) for x in bagminhash.near_duplicates(df).collect()) == want


def test_components_around_a_star(spark, monkeypatch):
    # One node has a third of all links; minima beyond the broadcast bound go by the split of hot nodes.
    n = 6000
    star = spark.range(1, n // 2).select(F.lit(5).cast("bigint").alias("u"), (F.col("id") + 10).alias("v"))
    pairs = spark.range(0, n).select((F.col("id") * 2 + 100_000).alias("u"), (F.col("id") * 2 + 100_001).alias("v"))
    for bound in (200_000, 10):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", bound)
        got = {r.node: r.component for r in components(star.unionByName(pairs)).collect()}
        assert all(got[v] == 5 for v in [5, *range(11, n // 2 + 10)])
        assert all(got[100_000 + 2 * i] == got[100_001 + 2 * i] == 100_000 + 2 * i for i in range(n))


def test_signatures_estimate_weighted_similarity():
    r = random.Random(4)
    base = [str(r.randrange(300)) for _ in range(500)] + ["x"] * 100
    texts = [" ".join(base)]
    for k in (2, 10, 30):
        words = list(base)
        for _ in range(k):
            words[r.randrange(500)] = str(r.randrange(300))
        texts.append(" ".join([*words, *["x"] * (k * 3)]))
    times = bagminhash.signatures(Texts(pa.array(texts)))
    for i in (1, 2, 3):
        assert abs((times[0] == times[i]).mean() - similarity(bag(texts[0]), bag(texts[i]))) < 0.17
    assert (bagminhash.signatures(Texts(pa.array(texts[::-1])))[::-1] == times).all()


def test_heavy_multiplicities_agree_only_up_to_the_lesser_weight():
    one, many = "a a a a a " * 40, "a a a a a " * 400
    times = bagminhash.signatures(Texts(pa.array([one, many, one])))
    assert (times[0] == times[2]).all()
    assert abs((times[0] == times[1]).mean() - 0.1) < 0.12


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (-5, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {-5: -5, 100: -5, 101: -5, 102: -5}


def brute_lines(rows, least):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites[line].add(source)
    return {line for line, s in sites.items() if len(s) >= least}


def test_line_dedup(spark, odd, none):
    rows = [(k, "\n".join([f"own line {k}", "everywhere", "half" if k % 2 else "other", "", "everywhere"]), f"s{k % 12}") for k in range(24)]
    rows += [(50, None, None), (51, "", "s1"), (52, "everywhere", None), (53, "half\n \nhalf", "s0"), (53, "half\n \nhalf", "s0")]
    df = spark.createDataFrame([(i, t, "en", s, 1, 0.5, 7, 3, "row", 1) for i, t, s in rows], SCHEMA)
    for least in (6, 7, 8, 13):
        gone = brute_lines(rows, least)
        want = Counter()
        for doc_id, text, _ in rows:
            lines = (text or "").split("\n")
            left = [x for x in lines if x not in gone]
            want[(doc_id, len(lines) if text else 0, len(lines) - len(left), "\n".join(left))] += 1
        got = line_dedup.cleaned(df, least)
        assert got.columns[:-1] == df.columns
        assert Counter((r.doc_id, r["__lines"].n_lines, r["__lines"].n_removed, r.text) for r in got.collect()) == want
    assert line_dedup.cleaned_digests(odd).count() == len(odd_rows())
    assert line_dedup.cleaned_digests(none).collect() == []

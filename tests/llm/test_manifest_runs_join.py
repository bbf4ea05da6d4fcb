"""Merkle manifest, periodic runs and the shingle join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import SCHEMA, docs, none, odd, odd_rows, prose, texts_of  # noqa: F401

from deltapath.llm import merkle, runs, shingle_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest -----------------------------------------------------------------


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return sha(field(doc_id) + field(source) + field(lang) + field(n_chars) + field(text))


def tree(nodes):
    """Root and, per node, the runs (place, run) on the way up."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        parts = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, where in enumerate(at):
            ways[i].append((where % 8, parts[where // 8]))
            at[i] = where // 8
        level = [sha("".join(p)) for p in parts]
    return level[0], ways


def brute_manifest(rows):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([g[2] for g in groups[lang]])
    root, upper = tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for (_, _, leaf, row), way in zip(groups[lang], trees[lang][1]):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate(small)
            folded, proof = leaf_of(row, text), ""
            for place, run in way + upper[k]:
                proof += "".join(run[:place] + run[place + 1 :])
                folded = sha("".join(run[:place] + [folded] + run[place + 1 :]))
            out.append((row[0], leaf, trees[lang][0], root, sha(proof), folded, folded == root))
    return Counter(out)


def manifest_rows(df, levels=merkle.LEVELS):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.verified(df, levels).collect())


def test_manifest(spark, odd, none):
    assert manifest_rows(odd) == brute_manifest(odd_rows())
    assert merkle.verified(none).collect() == []
    one = [(5, "Some TEXT", "en", None, None, 0.5, 1, 1, "r", 1)]
    assert manifest_rows(spark.createDataFrame(one, SCHEMA)) == brute_manifest(one)


def test_manifest_of_many_blocks(spark):
    # Blocks of 64 leaves: three rounds of appends; a hot language, many small ones, ties, repeated rows.
    r = random.Random(4)
    rows = [(i, f"Text {i % 7}", "en" if i % 3 else r.choice([None, "", "de", "fr", "ü"]), "s", i % 5, 0.5, 1, 1, "r", 1) for i in range(9000)]
    rows += [(10**6 + i, "x", f"l{i}", None, None, 0.5, 1, 1, "r", 1) for i in range(100)]
    rows += [(77, f"Other {i % 2}", "en", "s", 1, 0.5, 1, 1, "r", 1) for i in range(5)]
    assert manifest_rows(spark.createDataFrame(rows, SCHEMA).repartition(7), 2) == brute_manifest(rows)


def test_appender_equals_whole_tree():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 500):
        nodes = [sha(str(i)) for i in range(n)]
        root, ways = tree(nodes)
        level = next(k for k in range(5) if 8**k >= n)
        a = merkle.Appender(level)
        for node in nodes:
            a.append(bytes.fromhex(node))
        assert a.close().hex() == root
        for node, witness, way in zip(nodes, a.witness, ways):
            assert merkle.fold(node, bytes(witness)) == root
            assert merkle.siblings(bytes(witness)) == "".join("".join(run[:p] + run[p + 1 :]) for p, run in way)
            assert merkle.fold(sha("other"), bytes(witness)) != root


# --- runs ---------------------------------------------------------------------


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted([(s, e - s, q) for (s, e), q in found.items()], key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        if h % 10 == 0:
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(250):
        texts, codes, offsets, base = [], [], [0], 0
        for _ in range(r.randint(1, 4)):
            w = [r.randrange(r.randint(1, 5)) for _ in range(r.randint(0, 90))]
            for _ in range(r.randint(0, 3)):
                if len(w) > 8:
                    a, p = r.randrange(len(w)), r.randint(1, 11)
                    unit = w[a : a + p]
                    for i in range(a, r.randint(a, len(w))):
                        w[i] = unit[(i - a) % len(unit)]
            texts.append(w)
            codes += [base + x for x in w]
            base += 10
            offsets.append(len(codes))
        assert runs.find_runs(np.array(codes, np.int64), np.array(offsets)) == [brute_runs(w) for w in texts]


def test_wavelet_tree():
    r = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 1000):
        values = r.permutation(n)
        tree_ = runs.WaveletTree(values)
        first = r.integers(0, n, 200)
        last = np.minimum(first + r.integers(0, n + 1, 200), n)
        at = r.integers(0, n + 1, 200)
        after, before = tree_.successor(first, last, at), tree_.predecessor(first, last, at)
        for f, z, x, s, p in zip(first, last, at, after, before):
            own = values[f:z]
            assert s == min(own[own >= x], default=-1) and p == max(own[own < x], default=-1)


def test_periodic_runs(docs, odd, none):
    for df, rows in ((docs, list(texts_of(docs).items())), (odd, [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 100_000])):
        for plant in (False, True):
            want = Counter(brute_row(doc_id, text, plant) for doc_id, text in rows)
            got = runs.periodic_runs(df.where("coalesce(length(text), 0) < 100000"), plant).collect()
            assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == want
    assert runs.periodic_runs(none).collect() == []


def test_very_long_repetition(spark):
    text = " ".join(["a"] * 3000 + ["b", "c"] * 40_000 + prose(3, 2000).split())
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 3000, 80_000, 2)
    assert row.n_dropped == 2999 + 79_998


# --- shingle join ---------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 3 else frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= 90 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 90 * (len(a) + len(b) - both):
                    lead[root(i)] = root(j)
    order = lambda d: (d is None, d or 0)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = root(i)
        best[k] = min(best.get(k, d), d, key=order)
    return Counter((d, len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(rows))


def joined(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.components_of(df).collect())


def test_shingle_join(docs, odd, none):
    assert joined(docs) == brute_components(list(texts_of(docs).items()))
    assert joined(odd) == brute_components([(r[0], r[1]) for r in odd_rows()])
    assert shingle_join.components_of(none).collect() == []


def test_join_of_a_family_whose_members_miss_each_other(spark, monkeypatch):
    # A family in which most pairs are below the threshold, a chain, and texts that share a passage: blocks of several components.
    monkeypatch.setattr(shingle_join, "GROUP", 16)
    r = random.Random(6)

    def words(n):
        return [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(n)]

    rows, base, passage, chain = [], words(150), words(40), words(120)
    for _ in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append(" ".join(w))
    for _ in range(25):
        chain = list(chain)
        chain[r.randrange(120)] = f"y{r.randrange(10**6)}"
        rows.append(" ".join(chain))
    rows += [" ".join(passage + words(r.choice([0, 1, 2, 15]))) for _ in range(120)]
    rows += ["A b", "a B", "b a", "a", None, "", "a b c", "a b C"] + [" ".join(words(r.randint(0, 3))) for _ in range(20)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    found = []
    real = shingle_join._block_groups
    monkeypatch.setattr(shingle_join, "_block_groups", lambda *a: found.append(1) or real(*a))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_components(rows)
    assert found  # the block comparison has run


def test_prefixes_meet_under_every_order():
    # Any two sets that link share a shingle in the prefixes of each order.
    r = np.random.default_rng(3)
    rarity = r.integers(0, 80, 1 << shingle_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(r.integers(1, 120))
        pool = np.unique(r.integers(0, 1 << 63, n + 14).astype(np.uint64) * np.uint64(2))
        a = np.sort(r.choice(pool, n, replace=False))
        drop = int(r.integers(0, n // 10 + 1))
        rest = np.setdiff1d(pool, a)
        b = np.sort(np.concatenate([r.choice(a, n - drop, replace=False), rest[: int(r.integers(0, n // 10 + 1))]]))
        both = len(np.intersect1d(a, b))
        firsts = shingle_join.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rarity)
        if shingle_join.linked(both, len(a), len(b)):
            for tokens, cut in firsts:
                assert len(np.intersect1d(tokens[: cut[1]], tokens[cut[1] :]))

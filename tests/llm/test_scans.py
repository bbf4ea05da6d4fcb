"""Secret and license scans against regular expressions."""

import hashlib
import random
import re

import pyarrow as pa
from llm_rows import docs, none, odd, odd_rows, texts_of  # noqa: F401

from deltapath.llm import licenses, secret_scan
from deltapath.llm.automata import compile_rules, parse, reverse
from deltapath.llm.common import Texts
from deltapath.llm.license_texts import TEMPLATES

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def own_spans(scanner, texts):
    return [sorted((s, k, e) for s, e, k in x if k < 3) for x in scanner.scan(Texts(pa.array(texts)))]


def test_base_spans_on_random_texts():
    r = random.Random(3)
    parts = ["token", "secret", "Password", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "abc", "deadbeef0123", "AKIA", "ABCDEF123456", "é", "\n", "-", "x" * 13, "ſ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)]
    scanner = secret_scan.Scanner()
    assert own_spans(scanner, texts) == [base_spans(t) for t in texts]
    # Few texts are followed one by one, many side by side.
    assert own_spans(scanner, texts[:20]) == [base_spans(t) for t in texts[:20]]


def test_secret_query_rows(spark, docs, odd, none):
    kinds = ["assign", "access", "hex"]
    for df, rows in ((docs, list(texts_of(docs).items())), (odd, [(r[0], r[1] or "") for r in odd_rows()])):
        want = []
        for doc_id, text in rows:
            spans = base_spans(text)
            digest = hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
            want.append((doc_id or -1, *(sum(k == i for _, k, _ in spans) for i in range(3)), digest))
        assert sorted(((r.doc_id or -1), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan_documents(df).collect()) == sorted(want)
    assert secret_scan.scan_documents(none).collect() == []


def test_added_rules_and_redaction(spark):
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-1234567890-abc AIza" + "x" * 35
    scanner = secret_scan.Scanner()
    found = {scanner.rules[k].kind: text[s:e] for s, e, k in scanner.scan(Texts(pa.array([text])))[0]}
    assert found == {"private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abc", "google": "AIza" + "x" * 35}
    df = spark.createDataFrame([(1, "my token = abcdefabcdef1234 ok"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.redact(df).collect()} == {1: "my [secret] ok", 2: ""}


def test_automaton_is_the_language():
    r = random.Random(5)
    patterns = ["ab?c+", "(ab|ba)*c", "[a-c]{3}", "a(b|c)?a"]
    dfa = compile_rules([parse(p) for p in patterns], anywhere=False)
    back = compile_rules([reverse(parse(p)) for p in patterns], anywhere=False)

    def run(d, s):
        state = d.start
        for c in s.encode():
            state = int(d.table[state + d.classes[c]])
        return int(d.accepts[state // d.width])

    for _ in range(3000):
        s = "".join(r.choice("abcd") for _ in range(r.randrange(7)))
        want = sum(1 << k for k, p in enumerate(patterns) if re.fullmatch(p, s))
        assert run(dfa, s) == want and run(back, s[::-1]) == want


def test_license_notices_are_found_where_they_stand(spark, docs):
    short = {k: v for k, v in TEMPLATES.items() if len(v) < 90}
    texts = texts_of(docs)
    for r in licenses.scan_documents(docs).collect():
        text = texts[r.doc_id]
        assert r.licenses == ",".join(sorted(k for k, v in short.items() if v.rstrip(".") in text))
        for span in filter(None, r.spans.split(",")):
            name, start, end, share = span.split(":")
            assert text[int(start) : int(end)] == TEMPLATES[name].rstrip(".") and float(share) == 1.0


def test_changed_license_is_aligned():
    index = licenses.LicenseIndex(TEMPLATES)
    body = TEMPLATES["mit-permission"]
    words = body.upper().split()
    dropped = " ".join(w for i, w in enumerate(words) if i % 15 != 7)
    half = body[: len(body) // 2]
    found = index.scan(Texts(pa.array(["é intro " + dropped + " outro", half, "", "nothing here"])))
    assert [(index.names[k], 0.8 <= share < 1) for _, _, k, share in found[0]] == [("mit-permission", True)]
    start, end = found[0][0][:2]
    assert start == len("é intro ".encode()) and end == len(("é intro " + dropped).encode())
    assert found[1:] == [[], [], []]


def test_related_licenses_have_their_own_names():
    index = licenses.LicenseIndex(TEMPLATES)
    gpl = TEMPLATES["gpl-header"]
    want = {
        gpl: "gpl-header",
        gpl.replace("General", "Lesser General"): "lgpl-3.0-header",
        gpl.replace("General", "Affero General"): "agpl-3.0-header",
        gpl.replace("version 3", "version 2"): "gpl-2.0-header",
        gpl.replace("version 3", "version 4"): "gnu-license",
        gpl.replace("General", "Other General"): "gnu-license",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.0.": "gpl-3.0-notice",
        "This work is licensed under the GNU General Public License, version 3.1.": "gnu-license",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1-notice",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007": "agpl-3.0-title",
        "Licensed under CC BY-ND 4.0.": "cc-by-nd-4.0-notice",
        "Licensed under CC BY-SA 3.0.": "cc-by-sa-3.0-notice",
        "Licensed under CC BY 4.0.": "cc-by-4.0-notice",
        "Licensed under CC BY-SA 1.0.": "creative-commons-license",
        "Licensed under CC0 1.0.": "cc0-1.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.": "cc-by-nc-3.0-statement",
        "Licensed under the Apache License, Version 1.1.": "apache-license",
        "Released under the BSD 3-Clause License.": "bsd-3-clause-notice",
        "Released under the ZPL License.": "license-notice",
    }
    texts = ["Some words before. " + t + " Some words behind." for t in want]
    got = [[index.names[k] for _, _, k, _ in x] for x in index.scan(Texts(pa.array(texts)))]
    assert got == [[name] for name in want.values()]


def test_every_template_is_found_by_its_own_name():
    index = licenses.LicenseIndex(TEMPLATES)
    names = list(TEMPLATES)
    got = index.scan(Texts(pa.array([TEMPLATES[n] for n in names])))
    assert [[(index.names[k], share) for _, _, k, share in x] for x in got] == [[(n, 1.0)] for n in names]


def test_winnowing_keeps_a_fingerprint_of_every_common_stretch():
    r = random.Random(6)
    shared = "".join(r.choice("abcdefghij") for _ in range(licenses.GRAM + licenses.WINDOW - 1))
    for k in range(200):
        noise = lambda: "".join(r.choice("klmnopqrst") for _ in range(r.randrange(40)))
        prints = []
        for t in (noise() + shared + noise(), noise() + shared + noise()):
            prints.append(set(licenses.fingerprints(licenses.normal(Texts(pa.array([t])))[0])[1].tolist()))
        assert prints[0] & prints[1]


def test_license_rows_of_odd_texts(spark, odd, none):
    rows = licenses.scan_documents(odd).collect()
    assert len(rows) == len(odd_rows())
    assert [r.licenses for r in rows if r.doc_id == 11] == ["cc-by-nc-4.0-notice"] * 2
    assert licenses.scan_documents(none).collect() == []


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(row[j + 1], row[j])
            before = here
    return row[-1]


def test_bit_parallel_common_subsequence():
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(1, 90))) for _ in range(2))
        pattern = licenses.Pattern(licenses.normal(Texts(pa.array([a])))[0][licenses.GAP : -licenses.GAP])
        assert pattern.common(b.encode()) == common_subsequence(a, b)


def test_candidates_that_are_not_aligned_have_no_match(docs, monkeypatch):
    texts = [r.text or "" for r in docs.select("text").collect()]
    given = sorted(TEMPLATES)
    r = random.Random(2)
    for _ in range(40):  # edited notices
        words = TEMPLATES[r.choice(given)].split()
        for _ in range(r.randint(0, len(words) // 4 + 1)):
            words[r.randrange(len(words))] = r.choice(["other", "", "foreign words", "x"])
        texts.append("Before it. " + " ".join(words) + " Behind it.")
    t = Texts(pa.array(texts))
    index = licenses.LicenseIndex(TEMPLATES)
    fast = index.scan(t)
    monkeypatch.setattr(licenses.Pattern, "common", lambda self, region: self.n)
    assert index.scan(t) == fast and sum(map(bool, fast)) > 20


def names_and_coverage(text):
    index = licenses.LicenseIndex(TEMPLATES)
    return [(index.names[k], share) for _, _, k, share in index.scan(Texts(pa.array([text])))[0]]


def test_edited_short_notice_and_foreign_words():
    assert [round(share, 2) for _, share in names_and_coverage("All right reserved.")] == [0.94]
    notice = max(TEMPLATES.values(), key=len)
    assert names_and_coverage(notice)[0][1] == 1.0
    # A foreign word behind each second one: the span holds far more than the template.
    mixed = " ".join(w + (" intermezzo" if i % 2 else "") for i, w in enumerate(notice.split()))
    assert all(share < 1.0 for _, share in names_and_coverage(mixed))

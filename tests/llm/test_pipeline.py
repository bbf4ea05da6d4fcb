"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from llm_rows import none, odd  # noqa: F401
from test_dedup import bag, order, similarity
from tokenizers import Tokenizer

from deltapath.llm import mixing, quality_rules
from deltapath.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_have_the_set_order_and_columns(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    names = rows.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = rows
        rows = written(stage(spark, rows, SF), name)
        if name != "byte_bpe":
            assert rows.columns == names
    ids = {name: [r.doc_id for r in df.collect()] for name, df in inputs.items()}
    assert list(ids) == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]

    kept = [r.doc_id for r in quality_rules.judge(inputs["quality_rules"]).where("kept").collect()]
    assert Counter(ids["exact_dedup"]) == Counter(kept)

    best = {}
    for r in inputs["exact_dedup"].collect():
        norm = re.sub(r"[\x20\x09-\x0D]+", "", r.text)
        best[norm] = min(best.get(norm, (1, order(r.doc_id), r.doc_id)), (-len(r.text), order(r.doc_id), r.doc_id))
    assert Counter(ids["near_dedup"]) == Counter(x[2] for x in best.values())

    texts = {r.doc_id: r.text for r in inputs["near_dedup"].collect()}
    bags, lead = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and lead[i] != lead[j] and similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((lead[i], lead[j]))
                lead = {k: a if v == b else v for k, v in lead.items()}
    assert Counter(ids["source_mix"]) == Counter(set(lead.values()))

    want = Counter()
    for r in mixing.mix(inputs["source_mix"]).collect():
        want[r.doc_id] += r.copies
    assert Counter(ids["byte_bpe"]) == +want

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in inputs["byte_bpe"].collect()}
    for r in rows.collect():
        got = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for df in (odd, none):
        rows = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, SF), name)
            assert rows.columns == df.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert {"doc_id", "n_tokens"} <= set(rows.columns)
        assert rows.count() >= 0

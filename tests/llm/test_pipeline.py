"""The pipeline against the operators' plain versions, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from joinery.llm import langid, quality
from tests.llm.test_minhash import brute


def test_stages(spark, sf, tokenizer):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near duplicates", "packing"]
    docs = corpus_pipeline.table(spark, sf, "documents")
    labels = corpus_pipeline.table(spark, sf, "labels")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.score >= 0.3}
    assert {r.doc_id for r in good.collect()} == kept

    known = stages["language"](spark, good, sf)
    assert known.columns == docs.columns
    clear = {r.doc_id for r in langid.identify(good).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert {r.doc_id for r in known.collect()} == clear

    alone = stages["near duplicates"](spark, known, sf)
    assert alone.columns == docs.columns
    groups = brute([(r.doc_id, r.text) for r in known.collect()])
    firsts = {i for i, (_, c) in groups.items() if i == c}
    assert {r.doc_id for r in alone.collect()} == firsts

    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == firsts
    assert sum(r.length for r in final) == sum(r.doc_tokens for r in final if r.start == 0)


def test_stages_take_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns and len(rows) <= docs.count()

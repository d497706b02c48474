"""The corpus pipeline against a plain version of each stage's decision."""

from __future__ import annotations

import collections

import corpus_pipeline

from kinweave.llm import decontam, langid, mixing, ngram_join
from kinweave.llm.shared import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DATA), "t")
        ids = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert set(ids) <= was
        if name == "language_id":
            model = langid.train(before.where(~langid.held_out(before["doc_id"])).select("doc_id", "text", "lang"))
            assert set(ids) == {r["doc_id"] for r in langid.predict(before, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
        elif name == "ngram_jaccard_join":
            assert set(ids) == {r["class_id"] for r in ngram_join.ngram_jaccard_join(before).collect()}
        elif name == "decontamination":
            assert set(ids) == was - {r["doc_id"] for r in decontam.find_leaks(before, table(spark, DATA, "benchmark")).collect()}
        elif name == "mixing":
            want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
            assert dict(ids) == want
        if name != "token_ids":
            assert docs.columns == columns
        kept.append(docs.count())
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len(rows) == kept[-1] and sorted(rows) == sorted(docs.collect())
    assert sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)

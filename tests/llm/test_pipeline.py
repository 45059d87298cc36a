from __future__ import annotations

import corpus_pipeline
from tableprep.session import materialize


def test_stages_one_after_another(spark, documents, document_rows):
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == documents.columns
    distinct = len({t.lower() for _, t, *_ in document_rows})
    assert counts[0] == len(document_rows) and distinct >= counts[2] > 0.8 * distinct
    assert docs.columns == ["doc_id", "tokens", "n_tokens", "round_trip"] and docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == counts[-1]


def test_edge_rows_pass_every_stage(spark, edge_docs, no_docs):
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, ""), name)
        assert (docs.count() > 0) == (start is edge_docs)

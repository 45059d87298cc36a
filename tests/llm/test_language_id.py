from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tableprep.llm import language_id
from tableprep.llm.common import held_out


def test_held_out_rows_follow_crc32(documents):
    for r in documents.select("doc_id", held_out(F.col("doc_id")).alias("out")).collect():
        assert r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_accuracy_on_rows_never_learned_from(documents):
    rows = language_id.fit(documents).predict(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(own) > 30 and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_follow_the_plain_formula(documents):
    model = language_id.fit(documents)
    text = "Der schnelle Fuchs, the quick fox"
    hashed, _ = language_id.features([text])
    plain = [model.log_prior[k] + sum(model.log_probability[k][b] for b in hashed.ravel() if b) for k in range(len(model.languages))]
    assert abs(model.scores([text, "other"])[0] - plain).max() < 1e-6


def test_texts_of_a_batch_do_not_touch():
    real = lambda x: sorted(v for v in x.ravel().tolist() if v)
    alone = real(language_id.features(["abc"])[0])
    hashed, places = language_id.features(["xyz", "abc", ""])
    assert real(hashed[places[1] : places[2]]) == alone


def test_edge_rows(edge_docs, edge_rows):
    rows = language_id.fit(edge_docs).predict(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r["doc_id"] in (3, 4, 5, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de", "fr")


def test_no_rows_and_no_languages(spark, no_docs, edge_docs):
    assert language_id.fit(no_docs).predict(no_docs).count() == 0
    model = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in model.predict(edge_docs).collect()} == {"und"}


def test_stage_drops_only_texts_without_language(edge_docs):
    left = language_id.fit(edge_docs).accepted(edge_docs)
    assert left.columns == edge_docs.columns
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 6, 7, 8, 9, 11, 12, 13, 14, None}


def test_numerals_are_no_letters(spark, edge_docs):
    texts = ["½", "² ① Ⅷ", "१२३", "ª", "中", "½ and"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.fit(edge_docs).predict(docs).collect()}
    assert [found[i] == "und" for i in range(len(texts))] == [True, True, True, False, False, False]

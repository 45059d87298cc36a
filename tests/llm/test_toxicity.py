from __future__ import annotations

import zlib

from tableprep.llm import toxicity

WORDS = ["scum", "idiot", "worthless"]


def made(spark, n=600):
    docs, labels = [], []
    for i in range(n):
        words = [f"plain{i * k % 89}x{chr(97 + i * k % 23)}" for k in range(1, 30)]
        toxic = i % 5 == 0
        if toxic:
            words[3:3] = [WORDS[i % 3], WORDS[(i + 1) % 3]]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert toxicity.fold("ІDI0T") == "idiot" and toxicity.fold("1d1​ot") == "idiot"
    assert toxicity.fold("w0rth1ess ѕcum 5tupid ｃｌｏｗｎ") == "worthiess scum stupid clown"
    assert toxicity.fold("Ünïcode 2024!") == "ünïcode 2024!"


def test_learned_lexicon_on_held_out_rows(spark):
    docs, labels = made(spark)
    model = toxicity.fit(docs, labels)
    assert {"scum", "idiot", "worthless"} <= set(model.lexicon) and not any(p.startswith("plain") for p in model.lexicon)
    rows = model.predict(docs).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_disguised_words_count_and_exceptions_do_not(spark):
    model = toxicity.ToxicityModel({"clown": 4.0, "scum": 4.0}, ("clown fish",), 3.0, -4.0)
    assert model.measure("you сl0wn") == model.measure("you clown") > 0
    assert model.measure("a clown fish") == 0 and model.measure("a clown fish, a clown") > 0
    assert model.measure("subscumber") == 0  # beginnings of words only
    assert model.measure("scum " + "word " * 10) > model.measure("scum " + "word " * 1000) > 0


def test_edge_rows(spark, edge_docs, edge_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.fit(edge_docs, labels).predict(edge_docs).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1


def test_no_rows(spark, no_docs, edge_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(no_docs, none).predict(no_docs).count() == 0
    assert {r["predicted"] for r in toxicity.fit(edge_docs, none).predict(edge_docs).collect()} <= {0, 1}

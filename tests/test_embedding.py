"""The fitted text embedding."""

from __future__ import annotations

import numpy as np
import pytest

from tableprep.operators import embedding
from tableprep.plans.execute import load_preprocessor, prepare


@pytest.fixture(scope="module")
def topics(spark):
    """Texts of three vocabularies; a few terms are common to all."""
    draw = np.random.default_rng(1)
    words = {t: [f"{t}{i}" for i in range(40)] for t in ("sea", "hill", "town")}
    rows = [(i, t, " ".join([*draw.choice(words[t], 25), *draw.choice(["the", "and", "of"], 15)])) for i in range(300) for t in [list(words)[i % 3]]]
    rows += [(900, "none", None), (901, "none", ""), (902, "none", "...")]
    return spark.createDataFrame(rows, "id int, topic string, t string").repartition(4)


def test_texts_of_a_topic_lie_together(topics):
    step = embedding.fit_embedding(topics.where("id < 200"), "t", dimensions=3)
    rows = step.apply(topics).orderBy("id").collect()
    vectors = np.array([r["t_embedding"] for r in rows])
    assert np.allclose(np.linalg.norm(vectors[:300], axis=1), 1, atol=1e-5) and not vectors[300:].any()
    near = vectors[200:300] @ vectors[:200].T
    agreed = [rows[200 + i]["topic"] == rows[int(j)]["topic"] for i, j in enumerate(near.argmax(axis=1))]
    assert np.mean(agreed) == 1.0


def test_the_basis_is_that_of_the_whole_matrix(spark, topics):
    """The subspace equals the one numpy finds from all rows at once, where the singular values part."""
    step = embedding.fit_embedding(topics, "t", dimensions=3, buckets=256, iterations=8)
    rows = topics.select(embedding._buckets("t", 256).alias("terms")).collect()
    basis, idf = np.zeros((256, 3)), np.zeros(256)
    for r in step.tables["basis"].collect():
        basis[r["bucket"]], idf[r["bucket"]] = r["weights"], r["idf"]
    whole = np.zeros((len(rows), 256))
    for i, r in enumerate(rows):
        for b, n in zip(*np.unique(r["terms"], return_counts=True)) if r["terms"] else ():
            whole[i, b] = (1 + np.log(n)) * idf[b]
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
    want = np.linalg.svd(whole, full_matrices=False)[2][:3].T
    assert np.allclose(np.linalg.svd(want.T @ basis)[1], 1, atol=1e-3)


def test_long_texts_and_no_rows(spark, topics):
    step = embedding.fit_embedding(topics, "t", dimensions=4)
    long = spark.createDataFrame([(1, "sea1 hill2 " * 200_000), (2, "sea1 hill2")], "id int, t string")
    found = {r["id"]: r["t_embedding"] for r in step.apply(long).collect()}
    assert np.allclose(found[1], found[2], atol=1e-4)
    none = embedding.fit_embedding(topics.limit(0), "t", dimensions=4)
    assert not np.array([r["t_embedding"] for r in none.apply(topics).collect()]).any()


def test_a_plan_fits_an_embedding_and_reads_it_back(spark, topics, tmp_path):
    plan = {
        "plan_name": "topics", "status": "executable", "task_type": "classification", "input_files": ["t.parquet"], "target_column": "topic", "id_columns": ["id"],
        "feature_columns": ["t"], "text_processing_plan": [{"columns": ["t"], "method": "embedding", "params": {"dimensions": 5}}],
        "split_strategy": {"strategy": "random", "train_size": 0.8}, "output_artifacts": [{"artifact_type": "preprocessor", "path": "p"}],
    }
    done = prepare(topics, plan)
    assert done.rows.columns == ["t_embedding", "topic", "split"]
    done.write_preprocessor(str(tmp_path / "p"))
    again = load_preprocessor(spark, str(tmp_path / "p")).apply(topics)
    assert sorted(map(str, again.collect())) == sorted(map(str, done.rows.drop("split").collect()))

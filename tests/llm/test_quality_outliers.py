from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import quality_outliers as q

WORD, GAP = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if GAP.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_statistics(documents, document_rows):
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in q.judge(documents).collect()}
    assert got == {i: plain(t) for i, t, *_ in document_rows}


def test_edge_rows(edge_docs, edge_rows):
    rows = q.judge(edge_docs).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in rows)) == sorted(plain(t) for _, t, *_ in edge_rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # too few rows for an estimate


def test_no_rows(no_docs):
    assert q.judge(no_docs).count() == 0


def clean_text(rng):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(40, 400)))


@pytest.fixture(scope="module")
def judged(spark):
    """Clean texts of two sources, one in nine with junk symbols."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(450):
        text = clean_text(rng)
        if i % 9 == 0:
            text = text.replace(" ", "### ")
        rows.append((i, text, "en", "ab"[i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return q.judge(docs).cache().toPandas()


def test_outliers_go_and_clean_texts_stay(judged):
    junk = judged["doc_id"] % 9 == 0
    assert not judged[junk]["kept"].any()
    assert judged[~junk]["kept"].mean() > 0.99


def vectors(rows):
    words, chars = rows["n_words"].clip(lower=1), rows["word_chars"].clip(lower=1)
    return np.stack([
        np.log(words), np.log(chars / words), np.log1p(100 * rows["n_symbols"] / chars), np.log1p(rows["n_dup_lines"]),
        np.sqrt(rows["n_repeat_words"] / words),
    ], axis=1)


def brute_force(x):
    """The same concentration steps in numpy."""
    best = None
    quartiles = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    starts = [(quartiles[1], (quartiles[2] - quartiles[0]) / 1.349), (x.mean(0), x.std(0))]
    for centre, spread in starts:
        covariance = np.diag(np.maximum(spread, q.FLOORS) ** 2)
        for _ in range(q.STEPS):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(covariance), x - centre)
            bins = np.minimum(q.BINS - 1, np.floor(np.log1p(d2) * q.BINS_PER_FOLD))
            cut = np.sort(bins)[int(np.ceil(len(x) * q.SHARE)) - 1]
            inner = x[bins <= cut]
            centre = inner.mean(0)
            covariance = np.cov(inner.T, bias=True) * q.CONSISTENCY + np.diag(np.square(q.FLOORS))
        if best is None or np.linalg.slogdet(covariance)[1] < best[0] - 1e-12:
            best = np.linalg.slogdet(covariance)[1], centre, covariance
    return best[1:]


def test_distances_follow_a_brute_force_estimate(judged):
    for _, rows in judged.groupby("source"):
        x = vectors(rows)
        centre, covariance = brute_force(x[~rows["base_failed"].to_numpy()])
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(covariance), x - centre)
        assert np.allclose(d2, rows["distance"], rtol=1e-6, atol=1e-6)


def test_no_python_in_the_plan(documents, capsys):
    q.judge(documents.where(F.col("doc_id") < 20)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_constants():
    assert q._check_constant() == pytest.approx(q.CONSISTENCY, abs=0.01)

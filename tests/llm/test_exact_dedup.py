from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tableprep.llm import exact_dedup
from tableprep.llm.exact_dedup import BASES, MODULI, Fingerprints, combine

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest, left = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            stays = i == keep and left > 0
            left -= stays
            out.append((i, keep, len(ids), stays, digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_edge_rows(edge_docs, edge_rows):
    assert found(exact_dedup.exact_groups(edge_docs)) == expected(edge_rows)


def test_documents(documents, document_rows):
    assert found(exact_dedup.exact_groups(documents)) == expected(document_rows)


def test_no_rows(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, f"text number {i % 40:02d}", None, None) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    assert found(exact_dedup.exact_groups(docs, moduli=(3, 5))) == expected(rows)


def test_chunks_combine_to_the_whole():
    text = bytes(range(256)) * 40
    whole = Fingerprints().of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    for cut in (0, 1, 4096, 5000, len(text)):
        halves = []
        for part in (text[:cut], text[cut:]):
            value = Fingerprints().of(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
            halves.append((int(value) >> 31, int(value) & ((1 << 31) - 1)))
        both = [combine(halves[0][k], halves[1][k], cut, BASES[k], MODULI[k]) for k in range(2)]
        assert both[0] << 31 | both[1] == whole


@pytest.mark.parametrize("repeats", [1, 2])
def test_stage_keeps_one_row_of_each_text(spark, edge_docs, edge_rows, repeats):
    docs = edge_docs if repeats == 1 else edge_docs.unionByName(edge_docs)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t, *_ in edge_rows})

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from tableprep.llm import sentencepiece_dropout as sp
from tableprep.llm.sentencepiece_dropout import DEFAULT_MODEL, PieceModel

pytestmark = pytest.mark.skipif(not Path(DEFAULT_MODEL).exists(), reason="no model file")
TEXTS = ["Hello  world\n été x", "", " a", "a  ", "    \t x" * 9, "日本語 テスト 😀 ﬁ", "=" * 30, "naïve façade ​ end", "<s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def model():
    return PieceModel()


def tokens(model, text, rate=0.0, key=1, seed=1):
    return model.encode([text], np.array([key], np.uint64), rate, seed)[0].tolist()


def test_without_dropout_it_is_the_library_s_encoding(model, document_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    texts = [t for _, t, *_ in document_rows if t] + TEXTS
    flat, starts = model.encode(texts, np.arange(len(texts)).astype(np.uint64), 0.0, 1)
    for i, text in enumerate(texts):
        assert flat[starts[i] : starts[i + 1]].tolist() == library.encode(text), text[:50]


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_varies_and_decodes_to_the_text(model, rate):
    for text in [*TEXTS, "a literal ▁ mark ▁▁ here", "x" * 3000, "ab" * 500 + " end"]:
        got = tokens(model, text, rate)
        assert model.decode(got) == text
        assert got == tokens(model, text, rate)
    text = "several ordinary words that merge into larger pieces " * 5
    assert len({tuple(tokens(model, text, 0.3, key, seed)) for key in (1, 2) for seed in (1, 2)}) == 4
    assert len(tokens(model, text, rate)) > len(tokens(model, text))


def test_side_by_side_agrees_with_the_heap(model, monkeypatch, document_rows):
    texts = [t[:3000] for _, t, *_ in document_rows[:20] if t]
    keys = np.arange(len(texts)).astype(np.uint64)
    for rate in (0.0, 0.2):
        together = model.encode(texts, keys, rate, 9)[0]
        with monkeypatch.context() as patch:
            patch.setattr(sp, "LONGEST_UNIT", 4)
            by_heap = _with_heap(model, texts, keys, rate)
        assert (together == by_heap).all()


def _with_heap(model, texts, keys, rate):
    """The same encoding with every unit of more than one symbol given to the heap."""
    original = PieceModel._side_by_side

    def one_by_one(self, rows, unit_keys, dropout):
        out = np.full_like(rows, -1)
        sizes = np.zeros(len(rows), np.int64)
        for i, row in enumerate(rows):
            found = self._by_heap(row[row >= 0], unit_keys[i], dropout)
            out[i, : len(found)], sizes[i] = found, len(found)
        return out, sizes

    PieceModel._side_by_side = one_by_one
    try:
        return model.encode(texts, keys, rate, 9)[0]
    finally:
        PieceModel._side_by_side = original


def test_edge_rows(edge_docs, edge_rows):
    encoded = sp.encode(edge_docs)
    rows = encoded.collect()
    assert len(rows) == len(edge_rows) and encoded.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    for r in rows:
        if r["doc_id"] == 3:
            assert r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_tokens"] == len(r["tokens"])
    texts = {(i, t) for i, t, *_ in edge_rows}
    assert {(r["doc_id"], r["text"]) for r in sp.decode(encoded).collect()} == texts


def test_no_rows(no_docs):
    assert sp.encode(no_docs).count() == 0

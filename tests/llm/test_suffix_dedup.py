from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tableprep.llm import suffix_dedup as s


def brute_force(rows):
    seen = Counter()
    for _, text, *_ in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        edge = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=str)


def test_documents(documents, document_rows):
    assert found(s.repeated_spans(documents)) == brute_force(document_rows)


def test_edge_rows(edge_docs, edge_rows):
    assert found(s.repeated_spans(edge_docs)) == brute_force(edge_rows)


def test_no_rows(no_docs):
    assert s.repeated_spans(no_docs).count() == 0


def made():
    """Texts with repeats at borders, inside themselves, periodic ones and a passage in most of them."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdef gh"), n))
    passage, rows = word(260), []
    for i in range(60):
        parts = [word(int(rng.integers(0, 400)))]
        if i % 2:
            parts += [passage[int(rng.integers(0, 30)) : int(rng.integers(215, 260))], word(int(rng.integers(0, 300)))]
        if i % 7 == 0:
            parts += [parts[0][:199], "é" * 20, parts[0][:201]]
        if i % 11 == 0:
            parts += ["ab" * int(rng.integers(80, 160))]
        rows.append((i, "".join(parts), None, None))
    return rows


@pytest.mark.parametrize(("share", "largest"), [(2.0, 4096), (0.01, 4096), (2.0, 3), (0.01, 3)])
def test_borders_periods_hot_and_large_classes(spark, monkeypatch, share, largest):
    monkeypatch.setattr(s, "HOT_SHARE", share)
    monkeypatch.setattr(s, "HOT_SAMPLE", 4096 if share < 1 else 1)
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    assert found(s.repeated_spans(docs, largest_class=largest)) == brute_force(rows)


def test_sort_is_that_of_the_bytes():
    rng = np.random.default_rng(2)
    slices = [bytes(rng.choice([97, 98], rng.integers(200, 330)).astype(np.uint8)) for _ in range(12)]
    slices += [slices[0][:250], b"a" * 290, slices[3]]
    classes = [0] * 7 + [1] * 8
    data = np.frombuffer(b"".join(slices), np.uint8)
    offsets = np.cumsum([0, *map(len, slices)])
    windows = np.concatenate([np.arange(o, o + len(x) - 199) for o, x in zip(offsets, slices)])
    own = np.concatenate([[c] * (len(x) - 199) for c, x in zip(classes, slices)])
    order = s.SuffixSort(data).sort(windows, own)
    raw = data.tobytes()
    assert sorted(order) == sorted(windows)
    keys = [(c, raw[w : w + 200]) for c, w in zip(own, order)]
    assert keys == sorted(keys)


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(s.SuffixSort, "common", lambda self, a, b: np.full(len(a), s.MATCH))
    slices = [b"start000" + bytes([65 + i]) * 200 for i in range(3)]
    first, last = s.repeated_ranges(slices, [0, 0, 0])
    assert first.tolist() == [8, 8, 8] or (first == -1).all()
    assert s.repeated_ranges(slices[:2], [0, 1])[0].tolist() == [-1, -1]


def lines_around_unique_words():
    """A line repeated, words that stand nowhere else, and the line repeated again: the anchor recurs on both sides."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    rows = []
    for period in (20, 45, 70, 100, 130):
        line = word(period) + "\n"
        for _ in range(6):
            times = 400 // period + 1
            rows.append((len(rows), line * times + word(int(rng.integers(12, 41))) + line * times, None, None))
    return rows


@pytest.mark.parametrize("largest", [4096, 3])
def test_unique_words_between_repeated_lines_stay(spark, largest):
    rows = lines_around_unique_words()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    assert found(s.repeated_spans(docs, largest_class=largest)) == brute_force(rows)


def test_runs_of_a_slice_have_no_gaps():
    line = b"0123456789abcdefghijklmnopqrstuvwxyz\n" * 12
    owner, first, last = s.repeated_runs([line + b"nowhere else" + line], [0])
    assert owner.tolist() == [0, 0] and first.tolist() == [0, len(line) + 12] and last.tolist() == [len(line) - 200, 2 * len(line) + 12 - 200]


def test_of_equal_windows_two_are_sorted_however_many_there_are(monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(97, 123, 270, np.uint8)
    slices = []
    for k in range(200):  # near copies, each with a byte of its own
        own = base.copy()
        own[k % 40] = 48 + k // 40
        slices.append(own.tobytes())
    sorted_windows, sort = [], s.SuffixSort.sort
    monkeypatch.setattr(s.SuffixSort, "sort", lambda self, w, c: sorted_windows.append(len(w)) or sort(self, w, c))
    first, last = s.repeated_ranges(slices, [0] * len(slices))
    windows = [[text[i : i + s.MATCH] for i in range(len(text) - s.MATCH + 1)] for text in slices]
    counts = Counter(w for own in windows for w in own)
    hit = [[i for i, w in enumerate(own) if counts[w] > 1] for own in windows]
    assert [(min(h, default=-1), max(h, default=-1)) for h in hit] == [(a if b >= 0 else -1, b) for a, b in zip(first.tolist(), last.tolist())]
    assert sum(sorted_windows) <= 2 * len(counts) < sum(map(len, windows))

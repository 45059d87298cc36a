from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from tableprep.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] >= 3 * sizes[s]}
        if not over or not free:
            return target
        full |= over
        if len(full) == len(names):
            return {s: 3.0 * sizes[s] for s in names}


def check(rows, found):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken, lengths = plain_targets(dict(sizes)), defaultdict(int), defaultdict(list)
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] in [r["size"] * k for k in range(4)]
        taken[r["source"]] += r["taken"]
        lengths[r["source"]].append(r["size"])
    for source, words in taken.items():
        passes = min(3, int(want[source] // sizes[source])) if sizes[source] else 0
        budget = round(want[source] - passes * sizes[source]) if passes < 3 else 0
        sums = 1  # bit k: some documents have k words together
        for n in lengths[source]:
            sums |= sums << n
        assert words == passes * sizes[source] + (sums & ((2 << budget) - 1)).bit_length() - 1


def test_documents_meet_their_targets(documents, document_rows):
    check(document_rows, mixing.mix(documents).collect())


def test_edge_rows(edge_docs, edge_rows):
    found = mixing.mix(edge_docs).collect()
    want = plain_targets({s: sum(len(WORD.findall(t or "")) for _, t, _, x in edge_rows if x == s) for s in {r[3] for r in edge_rows}})
    assert {r["source"]: round(r["target"], 6) for r in found} == {s: round(t, 6) for s, t in want.items()}
    assert all(r["taken"] <= 3 * r["size"] for r in found)


def test_reruns_agree_whatever_the_partitioning(documents):
    one = sorted(tuple(r) for r in mixing.mix(documents).select("doc_id", "taken").collect())
    assert one == sorted(tuple(r) for r in mixing.mix(documents.repartition(7, "text")).select("doc_id", "taken").collect())
    assert one != sorted(tuple(r) for r in mixing.mix(documents, seed=7).select("doc_id", "taken").collect())


def test_no_rows(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0


def test_quota_meets_budget_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), rng.integers(1, 6), replace=False)
        counts = rng.integers(1, 5, len(lengths))
        whole = int((lengths * counts).sum())
        budget = int(rng.integers(0, whole))
        sums = {0}
        for length, count in zip(lengths, counts):
            sums = {s + k * int(length) for s in sums for k in range(count + 1)}
        best = max(s for s in sums if s <= budget)
        quota = mixing._knapsack(lengths, counts, budget)
        assert (quota <= counts).all() and int((quota * lengths).sum()) == best
        quota = mixing.fit_quota(lengths, counts, budget)
        assert (quota <= counts).all() and (quota >= 0).all() and int((quota * lengths).sum()) <= budget


def test_large_budgets_are_met_to_the_word():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    whole = int((lengths * counts).sum())
    for share in (0.01, 0.5, 0.999):
        budget = int(whole * share)
        assert int((mixing.fit_quota(lengths, counts, budget) * lengths).sum()) == budget


def test_one_length_for_all_rows_is_cut_at_the_quota(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_RANKED", 1)
    rows = [(i, "two words", "a") for i in range(3000)] + [(i, "one", "b") for i in range(3000, 3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    check([(i, t, None, s) for i, t, s in rows], found)


def test_stage_repeats_rows_as_often_as_taken(edge_docs):
    taken = mixing.mix(edge_docs).collect()
    mixed = mixing.apply_mix(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r["times"] for r in taken)


@pytest.mark.parametrize(("low", "high"), [(1, 40), (1, 20_000), (20_000, 300_000)])
def test_long_texts_are_met_like_brute_force(low, high):
    draw = np.random.default_rng(high)
    for _ in range(60):
        lengths = np.unique(draw.integers(low, high, draw.integers(2, 24)))
        counts = draw.integers(1, 4, len(lengths))
        budget = int((lengths * counts).sum() * draw.random())
        reached, mask = 1, (1 << (budget + 1)) - 1
        for length, n in zip(lengths.tolist(), counts.tolist()):
            for _ in range(n):
                reached |= (reached << length) & mask
        quota = mixing.fit_quota(lengths, counts, budget)
        assert (quota >= 0).all() and (quota <= counts).all()
        assert int((quota * lengths).sum()) == reached.bit_length() - 1


def test_a_source_of_few_long_texts(spark):
    words = {1: 150_000, 2: 150_000, 3: 150_000, 4: 200_001}
    rows = [(i, "w " * n, "a") for i, n in words.items()] + [(10 + i, "w " * 9_000, "b") for i in range(60)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target = next(r["target"] for r in found if r["source"] == "a")
    sums = {sum(n for i, n in words.items() if mask >> i & 1) for mask in range(32)}
    whole = sum(words.values())
    best = max(s + p * whole for s in sums for p in range(3) if s + p * whole <= round(target))
    assert sum(r["taken"] for r in found if r["source"] == "a") == best

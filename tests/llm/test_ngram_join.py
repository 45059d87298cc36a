from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tableprep.llm import ngram_join as n
from tableprep.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """(id, class_id, n_links) of every row, from all pairs."""
    sets, root = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in members.items()}
    return sorted(((rows[k][0], top[find(k)], links[k]) for k in range(len(rows))), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect()), key=str)


def near_copies(count, seed=8):
    """A text changed in a few places each time, another such family, and texts like no other."""
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(2):
        words = [f"w{base}x{k}" for k in range(120)]
        for _ in range(count):
            own = list(words)
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                own[at] = f"new{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(own), None, None))
    rows += [(len(rows) + k, " ".join(f"u{k}y{j}" for j in range(50)), None, None) for k in range(20)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK", block)
    rows = near_copies(40)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    assert found(n.near_groups(docs)) == brute_force(rows)


def test_edge_rows(edge_docs, edge_rows):
    assert found(n.near_groups(edge_docs)) == brute_force(edge_rows)


def test_no_rows(no_docs):
    assert n.near_groups(no_docs).count() == 0


def test_shingles_do_not_reach_over_texts():
    texts = ["a b c d e f", "", "  g h", "i j k l m", "é ü"]
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    sets = n.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), starts)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 1]
    for text, whole in zip(raw, sets):
        alone = n.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert (alone == whole).all()


def test_fewest_matches_are_where_the_posterior_meets_the_tolerance():
    least = n.fewest_matches(0.8, 1e-3)
    grid = (np.arange(200_000) + 0.5) / 200_000
    for count, m in least.items():
        mass = lambda k: (d := grid**k * (1 - grid) ** (count - k))[grid >= 0.8].sum() / d.sum()
        assert mass(m) >= 1e-3 > mass(m - 1)


def test_both_ways_of_intersecting_agree():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert n._shared(sets, a, b).tolist() == want and n._shared(sets, a[:9], b[:9]).tolist() == want[:9]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_stage_keeps_one_row_of_each_class(edge_docs, edge_rows):
    left = n.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids, key=str) == sorted({c for _, c, _ in brute_force(edge_rows)}, key=str)


def test_unrelated_texts_under_null_and_repeated_ids(spark):
    alone = lambda name: " ".join(f"{name}{j}" for j in range(60))
    rows = [(None, alone(f"n{k}x")) for k in range(5)] + [(7, alone(f"r{k}x")) for k in range(4)]
    rows += [(None, alone("n0x") + " more"), (None, alone("pair") + " one"), (None, alone("pair") + " two"), (7, alone("r0x") + " end"), (3, alone("r0x"))]
    rows += [(None, ""), (None, None), (None, " "), (7, ""), (7, "\t"), (None, alone("twice")), (None, alone("twice"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(n.near_groups(docs)) == brute_force(rows)
    left = [r["text"] for r in n.drop_near_copies(docs).collect()]
    assert len(left) == 5 + 4 + 1 + 5 + 1
    assert {(t or "").split(" ")[0] for t in left} == {(t or "").split(" ")[0] for _, t in rows}

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tableprep.llm import vantage_clusters
from tableprep.llm.vantage_clusters import VantageTree, centroid_text

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, vector string, inertia string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def expected(rows, dimensions=64, number=40, rounds=5):
    """Every distance to every centroid, in Python's whole numbers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    if not kept:
        return []
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:number]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, own) in zip(kept, near) if own == k]
            if mine:
                centroids[k] = tuple(sum(col) // len(mine) for col in zip(*mine))
    near = assign()
    inertia = sum(d for d, _ in near)
    per = [sum(d for d, k in near if k == c) for c in range(len(centroids))]
    return sorted(((i, k, d, per[k], inertia, centroid_text(np.array(centroids[k]))) for (i, _), (d, k) in zip(kept, near)), key=str)


def found(df):
    rows = df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def odd_rows(seed=3, dimensions=64):
    draw = np.random.default_rng(seed)
    plain = [(i, [float(x) for x in draw.normal(0, 0.2, dimensions)]) for i in range(130)]
    same = [(200 + i, [0.125] * dimensions) for i in range(30)]
    steps = [(300 + i, [float(x) for x in draw.integers(-1, 2, dimensions) / 256]) for i in range(40)]
    bad = [(400, None), (401, []), (402, [0.1] * (dimensions - 1)), (403, [None] + [0.1] * (dimensions - 1)),
           (404, [float("nan")] * dimensions), (405, [float("inf")] + [0.0] * (dimensions - 1))]
    repeated = [(7, [0.5] * dimensions), (7, [0.5] * dimensions), (None, [-0.5] * dimensions), (None, [0.25] * dimensions)]
    return [*plain, *same, *steps, *bad, *repeated]


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(vantage_clusters.cluster(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])]])
def test_no_vectors(spark, rows):
    assert found(vantage_clusters.cluster(table(spark, rows))) == []


def test_fewer_vectors_than_centroids(spark):
    rows = odd_rows()[:9]
    assert found(vantage_clusters.cluster(table(spark, rows))) == expected(rows)


def test_ties_in_one_dimension(spark):
    rows = [(i, [float(i % 17) / 256]) for i in range(300)]
    got = found(vantage_clusters.cluster(table(spark, rows), dimensions=1, number=9))
    assert got == expected(rows, dimensions=1, number=9)


def test_components_too_large_for_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        vantage_clusters.cluster(table(spark, [(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 26])
@pytest.mark.parametrize("number", [1, 2, 5, 40, 200])
def test_tree_finds_the_nearest(spread, number):
    draw = np.random.default_rng(number + spread)
    centroids = draw.integers(-spread, spread + 1, (number, 6))
    vectors = np.concatenate([draw.integers(-spread, spread + 1, (500, 6)), centroids])
    distance = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    nearest, least = VantageTree.of(centroids).nearest(vectors)
    assert (nearest == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


def test_tree_passes_subtrees_over():
    """Well parted groups: most centroids are never compared."""
    draw = np.random.default_rng(0)
    centroids = (np.repeat(np.arange(64) * 10_000, 4)[:, None] + draw.integers(0, 10, (256, 8))).astype(np.int64)
    tree, seen = VantageTree.of(centroids), []
    plain = vantage_clusters.squares
    try:
        vantage_clusters.squares = lambda d: (seen.append(len(d)), plain(d))[1]
        tree.nearest(centroids)
    finally:
        vantage_clusters.squares = plain
    assert sum(seen) < 256 * 256 / 4


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found(vantage_clusters.cluster(df)) == expected(rows)

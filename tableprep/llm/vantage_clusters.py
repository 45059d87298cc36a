"""Centroid clustering with integer vectors: each round looks the nearest centroid up in a vantage-point tree.

The tree is built over the centroids (their number is a parameter) and broadcast every round. A vector searches it best
first: of the subtrees it has yet to look into, the one with the least possible distance comes next, and one is passed
over only if that distance is beyond the best found so far, so that ties are seen. Distances that decide are exact
integers. Many vectors search side by side in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.session import materialize

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
LEAF = 4
# Components within this keep every squared distance of 64 dimensions inside a long.
LARGEST = 1 << 27
# Vectors that search side by side.
BLOCK = 4096
# Root distances are floating numbers; a subtree is passed over only if it is farther than the best by more than this share.
SLACK = 1e-9

VECTOR_SCHEMA = "vec_id long, vector array<int>"
TOO_LARGE = f"a vector has a component beyond {LARGEST // SCALE}: squared distances would not fit a long"


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vector): floor(256 * x) of the vectors that have just so many components, none null or not finite.

    A component whose size is beyond 2^19 is an error, as its distances could not be told in a long.
    """
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = kept.where((F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull()))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            finite = np.isfinite(x).all(axis=1)
            whole = np.floor(x[finite] * SCALE)
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(TOO_LARGE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(finite)), _lists(whole.astype(np.int32))], ["vec_id", "vector"])

    return kept.mapInArrow(scaled, VECTOR_SCHEMA)


def _lists(rows: np.ndarray) -> pa.Array:
    starts = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(rows.ravel()))


def first_centroids(vectors: DataFrame, number: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:vec_id`, in the order of the hash (and of the components, where ids
    repeat); a null id is hashed as the empty text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(number).collect()
    return np.array([r["vector"] for r in rows], np.int64)


@dataclass
class VantageTree:
    """Nodes side by side in arrays. A leaf has members; an inner node has a vantage point, which is a centroid of its
    own, and two subtrees with the range of their distances from it."""

    centroids: np.ndarray
    point: list[int]
    members: list[np.ndarray]
    children: list[tuple[int, ...]]
    ranges: list[tuple[tuple[float, float], ...]]

    @classmethod
    def of(cls, centroids: np.ndarray, leaf: int = LEAF) -> VantageTree:
        """Each vantage point is the centroid farthest from the one before it; the others are halved by their distance."""
        tree = cls(centroids, [], [], [], [])
        tree._grow(np.arange(len(centroids)), None, leaf)
        return tree

    def _grow(self, numbers: np.ndarray, before: int | None, leaf: int) -> int:
        """Halving keeps the depth at the logarithm of the number of centroids."""
        node = len(self.point)
        self.point.append(-1)
        self.members.append(numbers)
        self.children.append(())
        self.ranges.append(())
        if len(numbers) <= leaf:
            return node
        away = squares(self.centroids[numbers] - self.centroids[numbers[0] if before is None else before])
        vantage = int(numbers[np.argmax(away)])
        rest = numbers[numbers != vantage]
        distance = np.sqrt(squares(self.centroids[rest] - self.centroids[vantage]).astype(np.float64))
        order = np.argsort(distance, kind="stable")
        halves = [h for h in np.array_split(order, 2) if len(h)]
        self.point[node], self.members[node] = vantage, np.zeros(0, np.int64)
        self.ranges[node] = tuple((distance[h].min(), distance[h].max()) for h in halves)
        self.children[node] = tuple(self._grow(rest[h], vantage, leaf) for h in halves)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row; the smaller number on ties."""
        n = len(vectors)
        best = np.full(n, -1, np.int64)
        least = np.full(n, np.iinfo(np.int64).max, np.int64)
        radius = np.full(n, np.inf)
        # the queue of every vector: for each node the least distance its centroids can have, infinite if not queued
        queue = np.full((n, len(self.point)), np.inf)
        queue[:, 0] = 0.0
        open_rows = np.arange(n)
        while len(open_rows):
            heads = queue[open_rows].argmin(axis=1)
            nearest_bound = queue[open_rows, heads]
            going = np.isfinite(nearest_bound) & (nearest_bound <= radius[open_rows] * (1 + SLACK) + SLACK)
            open_rows, heads = open_rows[going], heads[going]
            for node in np.unique(heads):
                rows = open_rows[heads == node]
                bound = queue[rows, node]
                queue[rows, node] = np.inf
                here = [self.point[node]] if self.children[node] else self.members[node]
                for number in here:
                    away = squares(vectors[rows] - self.centroids[number])
                    better = (away < least[rows]) | ((away == least[rows]) & (number < best[rows]))
                    won = rows[better]
                    best[won], least[won] = number, away[better]
                    radius[won] = np.sqrt(away[better].astype(np.float64))
                    if self.children[node]:
                        distance = np.sqrt(away.astype(np.float64))
                        for child, (near, far) in zip(self.children[node], self.ranges[node]):
                            queue[rows, child] = np.maximum(bound, np.maximum(near - distance, distance - far))
        return best, least


def squares(difference: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", difference, difference)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = flat.reshape(-1, width)
    for first in range(0, len(rows), BLOCK):
        yield first, rows[first : first + BLOCK]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, sums of the components) of every cluster that has vectors; each task hands on one row a cluster."""
    width = centroids.shape[1]
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree.of(centroids))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(tree.value.centroids), np.int64)
        total = np.zeros((len(count), width), np.int64)
        for batch in batches:
            for _, rows in _blocks(batch, width):
                cluster, _ = tree.value.nearest(rows)
                np.add.at(total, cluster, rows)
                count += np.bincount(cluster, minlength=len(count))
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), _lists(total[full])], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(partial, "cluster long, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()  # one row a centroid
    tree.destroy()
    return rows


def moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    """Each centroid that has vectors goes to the floor of their mean."""
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return out


def centroid_text(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dimensions: int = DIMENSIONS,
    number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of the right form.

    Null vectors, vectors of another length and those with null, NaN or infinite components are left out. Rows that
    repeat an id are vectors of their own; a null id stays null. Fewer vectors than centroids give as many centroids as
    there are vectors; no vectors give an empty result. Other columns are ignored, whatever their names. The driver
    holds the centroids and one row of sums for each, nothing that grows with the table.
    """
    spark = table.sparkSession
    vectors = materialize(integer_vectors(table, id_col, vector_col, dimensions), "integer-vectors")
    centroids = first_centroids(vectors, number, seed)
    if not len(centroids):
        schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(centroids, _sums(vectors, centroids))
    tree = spark.sparkContext.broadcast(VantageTree.of(centroids))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _blocks(batch, dimensions):
                nearest, distance = tree.value.nearest(rows)
                ids = batch.column(0).slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = materialize(vectors.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned-vectors")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # one row a centroid
    whole = sum(r["inertia"] for r in inertia)
    facts = spark.createDataFrame(
        [(r["cluster"], r["inertia"], whole, centroid_text(centroids[r["cluster"]])) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

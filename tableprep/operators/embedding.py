"""A text embedding fitted on a table: hashed terms that occur together, reduced by a randomised singular value
decomposition.

Terms are hashed into a fixed number of buckets, so there is no vocabulary. Each pass over the texts multiplies the
term-by-term co-occurrence by a thin matrix (buckets by a few dozen columns): tasks sum their rows' shares of the product,
and only those sums, whose size the parameters fix, travel and are made orthogonal on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import quoted
from tableprep.operators.fitted import Fitted, StepData, Transform, fact, make, step_kind
from tableprep.operators.fitting import Answers, Fit, fit_together
from tableprep.operators.text import tokens
from tableprep.session import materialize

BUCKETS = 1 << 12
DIMENSIONS = 32
OVERSAMPLING = 16
ITERATIONS = 3
SEED = 42
# (bucket, row) pairs handled at once in a task, so that arrays of a few times their size stay small.
PIECE = 1 << 15


def embedding_fit(column: str, *, dimensions: int = DIMENSIONS, buckets: int = BUCKETS, iterations: int = ITERATIONS, seed: int = SEED) -> Fit:
    """A unit vector of `dimensions` numbers for every text; zeros for texts none of whose terms say anything."""

    def fit(df: DataFrame) -> DataFrame:
        rows = df.select(_buckets(column, buckets).alias("terms"))
        idf = _idf(rows, buckets)
        width = min(dimensions + OVERSAMPLING, buckets)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)) * (idf > 0)[:, None])[0]
        for _ in range(iterations):
            basis, _, _ = np.linalg.svd(_together(rows, idf, basis), full_matrices=False)
        basis = basis[:, :dimensions] * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(width)])[:dimensions]
        kept = [(i, float(idf[i]), basis[i].tolist()) for i in np.flatnonzero(idf).tolist()]
        return materialize(df.sparkSession.createDataFrame(kept, "bucket int, idf double, weights array<double>"), "embedding")

    def build(found: Answers) -> Fitted:
        params = {"column": column, "buckets": buckets, "dimensions": dimensions}
        out = f"{column}_embedding"
        return make("embedding", params, facts=[fact(column, "embedding", "dimensions", dimensions)], outputs={column: [out]}, tables={"basis": found.alone})

    return Fit([column], [column], build, alone=fit)


def fit_embedding(df: DataFrame, column: str, **options) -> Fitted:
    return fit_together(df, [embedding_fit(column, **options)])[0]


def _buckets(column: str, buckets: int):
    """The bucket of each term of a text."""
    return F.transform(tokens(F.coalesce(quoted(column).cast("string"), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _idf(rows: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket ln((N + 1) / (df + 1)); 0 for buckets no text has. A row a bucket comes to the driver."""
    total = rows.count()
    counted = rows.select(F.explode(F.array_distinct("terms")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).collect()
    idf = np.zeros(buckets)
    for r in counted:
        idf[r["bucket"]] = np.log((total + 1) / (r["df"] + 1))
    return idf


def _pieces(terms: pa.Array, idf: np.ndarray, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each pair, bucket, weight), a few whole rows at a time; weights of a row have length 1."""
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
    first, n = 0, len(ends) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, side="right")) - 1))
        rows = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
        pairs, times = np.unique(rows.astype(np.int64) * buckets + flat[ends[first] : ends[last]], return_counts=True)
        row, bucket = pairs // buckets, pairs % buckets
        weight = (1 + np.log(times)) * idf[bucket]
        length = np.sqrt(np.bincount(row, weight * weight, last - first))
        yield first, last - first, row, bucket, weight / np.where(length > 0, length, 1.0)[row]
        first = last


def _projected(rows: int, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The rows' weighted sums of the basis; pairs come in the order of their rows."""
    out = np.zeros((rows, basis.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[starts]] = np.add.reduceat(weight[:, None] * basis[bucket], starts, axis=0)
    return out


def _together(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The co-occurrence of the buckets, times the basis."""
    buckets, width = basis.shape
    known = rows.sparkSession.sparkContext.broadcast((idf, basis))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = known.value
        total = np.zeros((buckets, width))
        for batch in batches:
            for _, n, row, bucket, weight in _pieces(batch.column(0), idf, buckets):
                share = weight[:, None] * _projected(n, row, bucket, weight, basis)[row]
                order = np.argsort(bucket, kind="stable")
                if len(order):
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
                    total[bucket[order][starts]] += np.add.reduceat(share[order], starts, axis=0)
        full = np.flatnonzero(total.any(axis=1))
        offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total[full].ravel()))], ["bucket", "share"])

    parts = rows.mapInArrow(summed, "bucket int, share array<double>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(width)]).collect()  # a row a bucket
    known.destroy()
    out = np.zeros((buckets, width))
    for r in sums:
        out[r["bucket"]] = r[1:]
    return out


@step_kind("embedding")
def _embedded(data: StepData) -> Transform:
    column, buckets, dimensions = data.params["column"], data.params["buckets"], data.params["dimensions"]
    idf, basis = np.zeros(buckets), np.zeros((buckets, dimensions))
    for r in data.tables["basis"].collect():  # a row a bucket at most
        idf[r["bucket"]], basis[r["bucket"], : len(r["weights"])] = r["idf"], r["weights"]

    def vectors(terms: pa.Array) -> pa.Array:
        out = np.zeros((len(terms), dimensions), np.float32)
        for first, n, row, bucket, weight in _pieces(terms, idf, buckets):
            found = _projected(n, row, bucket, weight, basis)
            length = np.linalg.norm(found, axis=1, keepdims=True)
            out[first : first + n] = found / np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * dimensions), pa.array(out.ravel()))

    vectors.__annotations__ = {"terms": pa.Array, "return": pa.Array}
    encode = F.arrow_udf(vectors, "array<float>")
    return lambda rows: rows.withColumn(f"{column}_embedding", encode(_buckets(column, buckets))).drop(column)

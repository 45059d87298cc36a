"""Exact quantiles and ordered chunks against brute force, with limits small enough to bite."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.functions.quantiles import exact_quantiles, order_chunks

POINTS = [0.0, 0.25, 0.5, 0.7, 0.999, 1.0]


def values(kind: str) -> list[float]:
    rng = random.Random(3)
    if kind == "spread":
        return [rng.random() * 1e6 for _ in range(30_000)]
    if kind == "hot":  # one value holds a third, right below the median
        return [5.0] * 10_000 + [rng.random() * 10 for _ in range(20_000)]
    if kind == "tail":
        return [rng.paretovariate(0.5) for _ in range(30_000)]
    if kind == "infinite":
        return [float("inf")] * 9_000 + [float("-inf")] * 9_000 + [rng.random() for _ in range(9_001)]
    return [1.0] * 25_000


@pytest.mark.parametrize("kind", ["spread", "hot", "tail", "infinite", "constant"])
def test_quantiles_match_numpy(spark, kind):
    data = values(kind)
    df = spark.createDataFrame([(v,) for v in data], "x double").repartition(5)
    found = exact_quantiles(df, {"x": POINTS}, gather_limit=50)["x"]
    ordered = sorted(data)
    for p, got in zip(POINTS, found):
        spot = (len(ordered) - 1) * p
        low, high = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
        want = low if low == high else low + (high - low) * (spot - np.floor(spot))
        assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 2.0), (None, 4.0)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [3.0]}


def test_quantiles_of_times_are_microseconds(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_dt_interval(id) AS t FROM range(5)")
    assert exact_quantiles(df, {"t": [0.5]})["t"] == [1704067200e6 + 2 * 86400e6]


@pytest.mark.parametrize("hot", [7.0, None])
def test_chunks_follow_the_order_and_cut_hot_times(spark, hot):
    rows = [(hot if i % 3 == 0 else float(i), i) for i in range(6_000)]  # a third share one time
    df = order_chunks(spark.createDataFrame(rows, "t double, id bigint"), ["t", "id"], 12, "chunk")
    got = [tuple(r) for r in df.orderBy("t", "id").select("t", "id", "chunk").collect()]
    chunks = [c for *_, c in got]
    assert chunks == sorted(chunks)
    largest = df.groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert largest < 1_200  # the hot time alone has 2,000 rows


@pytest.mark.parametrize("hot", [7.0, None])
def test_chunks_are_cut_again_until_they_are_enough(spark, hot):
    rows = [(hot if i % 3 == 0 else float(i), i) for i in range(6_000)]
    df = order_chunks(spark.createDataFrame(rows, "t double, id bigint"), ["t", "id"], 60, "chunk", cuts=4)
    chunks = [r["chunk"] for r in df.orderBy("t", "id").select("chunk").collect()]
    assert chunks == sorted(chunks) and len(set(chunks)) >= 30
    assert df.groupBy("chunk").count().agg(F.max("count")).first()[0] < 400

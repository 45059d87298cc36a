"""Most frequent values by counters, samples in an order, and sketches of files."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.operators import heavy, profile, samples, sketches


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [1, 5, 50])
def test_counters_fall_short_by_what_they_lost(most):
    draw = np.random.default_rng(most)
    values = draw.zipf(1.3, 20_000) % 1000
    counters = heavy.Counters(most)
    for part in np.array_split(values, 17):
        counters.add(part)
    true = Counter(values.tolist())
    low = dict(zip(counters.keys.tolist(), counters.counts.tolist()))
    assert len(low) <= most and counters.lost <= len(values) / (most + 1)
    for value, n in true.items():
        assert n - counters.lost <= low.get(value, 0) <= n


@pytest.mark.parametrize("counters", [1, 8, 4096])
def test_heavy_values_are_the_top_values(spark, counters):
    df = spark.sql(
        "SELECT CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 97) END AS s, id AS own, CAST(sqrt(id) AS INT) AS n, "
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat(repeat('long ', 40), id % 11) END AS `a long.text`, CAST(NULL AS STRING) AS none, "
        "CAST('2024-01-01' AS DATE) + CAST(id % 40 AS INT) AS day, id % 2 = 0 AS even, array(id % 4) AS listed FROM range(6000)"
    ).repartition(5)
    assert rows_of(heavy.heavy_values(df, 7, counters=counters)) == rows_of(profile.top_values(df, 7))


def test_heavy_values_of_no_rows(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert heavy.heavy_values(df).count() == 0


def test_samples_come_in_the_order_asked_for(spark):
    df = spark.sql("SELECT CASE WHEN id > 3 THEN 1000 - id END AS place, concat('v', id % 13) AS v, id % 7 AS n, CAST(NULL AS INT) AS none FROM range(200)").repartition(7)
    seen: dict[str, list[str]] = {"v": [], "n": []}
    for r in sorted(df.collect(), key=lambda r: (r["place"] is None, r["place"] or 0)):
        for c in seen:
            if str(r[c]) not in seen[c]:
                seen[c].append(str(r[c]))
    found = {(r["name"], r["rank"]): r["value"] for r in samples.ordered_samples(df, "place", 6).collect()}
    assert found == {(c, i + 1): v for c in seen for i, v in enumerate(seen[c][:6])}


def test_samples_by_a_text_and_ties(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y"), (None, "w"), ("c", "z"), ("b", None)], "k string, v string")
    found = [r["value"] for r in samples.ordered_samples(df, "k", 9).orderBy("rank").collect()]
    assert found == ["y", "z", "x", "w"]


def test_sketches_of_halves_merge_to_the_whole(spark, tmp_path):
    df = spark.sql("SELECT id, id % 1000 AS few, CASE WHEN id % 4 > 0 THEN id * 0.5D END AS gap, concat('t', id % 30) AS word FROM range(20000)")
    halves = sketches.SketchCatalog(spark, str(tmp_path / "halves"))
    for half in (0, 1, 0):
        halves.add(df.where(F.col("id") % 2 == half), f"half-{half}")
    whole = {r["name"]: r for r in sketches.sketch_profile(sketches.column_sketches(df)).collect()}
    for r in halves.profile().collect():
        other = whole[r["name"]]
        for c in ("row_count", "non_null_count", "missing_count", "num_min", "num_max", "num_mean", "num_std"):
            assert r[c] == (None if other[c] is None else pytest.approx(other[c], rel=1e-9)), (r["name"], c)
        true = {"id": 20000, "few": 1000, "gap": 15000, "word": 30}[r["name"]]
        assert abs(r["unique_estimate"] - true) <= 0.07 * true
        if r["name"] != "word":
            middle = df.where(F.col(r["name"]) <= r["median_estimate"]).count() / r["non_null_count"]
            assert abs(middle - 0.5) < 0.02


def test_sketches_of_no_rows(spark, tmp_path):
    catalog = sketches.SketchCatalog(spark, str(tmp_path / "none"))
    catalog.add(spark.createDataFrame([], "a double, b string"), "none")
    rows = {r["name"]: r for r in catalog.profile().collect()}
    assert rows["a"]["row_count"] == 0 and rows["a"]["num_mean"] is None and rows["b"]["unique_estimate"] == 0

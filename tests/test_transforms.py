"""Transforms: invariants, brute force on skewed small tables, and independence of partitioning."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.operators import dates, encode, missing, remedies, scale, split, text
from tableprep.operators.split import split_shares


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds two thirds of the rows; every fourth value is known; times repeat."""
    return spark.sql(
        "SELECT id, CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 50) END AS k, "
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id div 2) AS t, CASE WHEN id % 4 = 0 AND id > 40 THEN id * 1.0D END AS v FROM range(4000)"
    )


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("key", [["k"], None])
@pytest.mark.parametrize(("chunks", "segment"), [(17, 1000), (90, 4)])
def test_chunked_fill_matches_pandas(skewed, direction, key, chunks, segment):
    got = missing.fill_in_order(skewed, ["v"], ["t", "id"], key=key, direction=direction, chunks=chunks, segment=segment)
    frame = skewed.toPandas().sort_values(["t", "id"])
    column = frame.groupby("k")["v"] if key else frame["v"]
    frame["v"] = column.ffill() if direction == "forward" else column.bfill()
    want = dict(zip(frame["id"], frame["v"]))
    for r in got.collect():
        assert (r["v"] is None and pd.isna(want[r["id"]])) or r["v"] == want[r["id"]]
    assert got.count() == 4000


def test_fills_leave_gaps_only_where_all_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a", None), (None, None, None), (3.0, "a", None)], "x double, s string, n double")
    for strategy in ("mean", "median", "mode"):
        done = missing.fit_fill(df, {"x": strategy, "n": strategy}).apply(df)
        assert done.where("x IS NULL").count() == 0 and done.where("n IS NULL").count() == 3
    assert missing.fit_fill(df, {"s": "mode"}).apply(df).where("s = 'a'").count() == 3


def test_integer_mean_widens(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows_of(missing.fit_fill(df, {"x": "mean"}).apply(df)) == [(1.0,), (1.5,), (2.0,)]


@pytest.mark.parametrize("shares", [(0.7, 0.15, 0.15), (0.5, None, None), (None, None, 0.25)])
def test_splits_cover_rows_once_in_any_partitioning(skewed, shares):
    bounds = split_shares(*shares)
    for run in (
        lambda df: split.random_split(df, ["id"], bounds),
        lambda df: split.stratified_split(df, ["id"], "k", bounds),
        lambda df: split.time_split(df, "t", bounds),
    ):
        want = rows_of(run(skewed.repartition(1)).select("id", "split"))
        assert want == rows_of(run(skewed.repartition(7)).select("id", "split"))
        assert [r[0] for r in sorted(want)] == list(range(4000))
        assert {r[1] for r in want} <= {n for n, _ in bounds}


def test_stratified_split_is_exact_per_class_with_copies_and_nulls(spark):
    rows = [("dup", "a")] * 100 + [(f"x{i}", "a") for i in range(200)] + [(f"y{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, label string")
    done = split.stratified_split(df, ["key"], "label", split_shares(0.8, None, 0.2))
    counts = {(r["label"], r["split"]): r["count"] for r in done.groupBy("label", "split").count().collect()}
    assert counts[(None, "train")] == 32 and counts[(None, "test")] == 8
    assert done.where("key = 'dup'").select("split").distinct().count() == 1
    assert sum(counts.values()) == 340


def test_bad_split_sizes():
    with pytest.raises(ValueError, match="between 0 and 1"):
        split_shares(1.0, None, None)
    with pytest.raises(ValueError, match="more than 1"):
        split_shares(0.9, None, 0.2)


def test_constant_columns_scale_to_zero_and_gaps_stay(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, float("nan"))], "c double, g double")
    for kind in ("standard", "minmax", "robust"):
        done = scale.fit_scaling(df, ["c", "g"], kind).apply(df).collect()
        assert [r["c"] for r in done] == [0.0, 0.0, 0.0]
        assert [r["g"] for r in done] == [0.0, None, None]
    assert scale.fit_scaling(df, ["c"], "log").apply(df.withColumn("c", F.lit(-2.0))).first()["c"] is None


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert rows_of(encode.fit_ordinal(train, "c").apply(rows)) == [(-1,), (-1,), (0,)]
    assert sorted(round(r[0], 4) for r in encode.fit_frequency(train, "c").apply(rows).collect()) == [0.0, 0.0, 0.6667]
    assert rows_of(encode.fit_one_hot(train, "c").apply(rows)) == [(0, 0), (0, 0), (1, 0)]
    with pytest.raises(Exception, match="unseen value"):
        encode.fit_one_hot(train, "c", handle_unknown="error").apply(rows).collect()


def test_ordinal_index_of_many_categories(spark, monkeypatch):
    monkeypatch.setattr(encode, "is_small", lambda *_: False)
    df = spark.range(500).selectExpr("lpad(cast(id AS string), 4, '0') AS c")
    index = encode.category_index(encode.category_counts(df, ["c"])["c"])
    assert {r["category"]: r["category_index"] for r in index.collect()} == {f"{i:04d}": i for i in range(500)}


def test_target_encoding_never_sees_its_own_row(spark):
    df = spark.range(200).selectExpr("id", "concat('c', id) AS c", "cast(id % 2 AS int) AS y")
    done = encode.fit_target(df, "c", "y", fold_key=["id"]).apply(df)
    assert done.where("abs(c - 0.5) > 1e-9").count() == 0  # singletons: nothing but the overall mean is left


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "")], "id int, t string")
    got = {(r["id"], r["term"]): (r["tf"], r["idf"]) for r in text.tfidf(df, ["id"], "t").collect()}
    import math
    assert got == {
        (1, "a"): (2, math.log(4 / 3)), (1, "b"): (1, math.log(2)), (2, "a"): (1, math.log(4 / 3)), (2, "c"): (1, math.log(2)),
    }


def test_sort_index_orders_across_partitions(skewed):
    parts = dates.sort_index(skewed, "t", 4).withColumn("p", F.spark_partition_id()).select("p", "t").collect()
    assert [r["t"] for r in sorted(parts, key=lambda r: r["p"])] == sorted(r["t"] for r in parts)


def test_rebalance_is_close_and_repeatable(skewed):
    df = skewed.withColumn("label", F.expr("CASE WHEN k = 'hot' THEN 1 ELSE 0 END"))
    thin = remedies.rebalance(df, "label", ["id"])
    counts = {r["label"]: r["count"] for r in thin.groupBy("label").count().collect()}
    assert counts[0] == 1333 and abs(counts[1] - 1333) < 120
    assert rows_of(thin.select("id")) == rows_of(remedies.rebalance(df.repartition(7), "label", ["id"]).select("id"))
    fat = {r["label"]: r["count"] for r in remedies.rebalance(df, "label", ["id"], method="over").groupBy("label").count().collect()}
    assert fat[1] == 2667 and abs(fat[0] - 2667) < 120


def test_copies_are_dropped_exactly(spark):
    df = spark.sql(
        "SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS a, CASE WHEN id % 3 = 0 THEN 'copy' ELSE cast(id AS string) END AS b, "
        "array(id % 2 * 0) AS c FROM range(300)"
    )
    want = rows_of(df.distinct())
    assert rows_of(remedies.drop_duplicate_rows(df)) == want and len(want) == 201
    with_map = df.withColumn("m", F.create_map(F.lit("k"), F.col("b")))
    assert remedies.drop_duplicate_rows(with_map).count() == 201
    assert remedies.drop_duplicate_rows(df, ["a"]).count() == 8


def test_stratified_split_lengthens_its_prefixes(spark, monkeypatch):
    df = spark.range(3000).withColumn("kind", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    shares = split.split_shares(0.6, 0.2, 0.2)
    plain = split.stratified_split(df, ["id"], "kind", shares)
    monkeypatch.setattr(split, "DIGEST_PREFIX", 1)
    monkeypatch.setattr(split, "ROWS_PER_PREFIX", 5)
    longer = split.stratified_split(df, ["id"], "kind", shares)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, longer.collect()))


def test_vectors_join_once_per_row(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (None, "w")], "k int, t string")
    vectors = spark.createDataFrame([(1, [0.5]), (1, [0.25]), (3, [1.0]), (None, [9.0])], "v int, e array<double>")
    found = {r["t"]: r["embedding"] for r in text.join_embeddings(rows, vectors, "k", "v", "e").collect()}
    assert found == {"x": [0.25], "y": None, "z": None, "w": None}

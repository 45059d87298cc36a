from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F

from tableprep.functions.joins import is_small, lookup
from tableprep.operators import encode


def test_lookup_splits_hot_keys_beyond_the_broadcast_limit(spark):
    rows = [("hot",)] * 300 + [(f"k{i}",) for i in range(500)] + [(None,)] * 200 + [("unseen",)] * 3
    df = spark.createDataFrame(rows, "k string")
    table = df.where("k IS NOT NULL AND k <> 'unseen'").groupBy("k").count().selectExpr("k", "count AS n", "length(k) AS size")
    small = lookup(df, table, ["k"], weight="n")
    large = lookup(df, table, ["k"], weight="n", broadcast_rows=10)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.count() == len(rows)
    assert large.where("k = 'hot' AND size = 3").count() == 300
    assert large.where("size IS NULL").count() == 203


def test_lookup_reads_its_rows_once_beyond_the_limit(spark, capsys):
    df = spark.createDataFrame([(f"k{i % 50}", i) for i in range(500)], "k string, x int")
    table = df.groupBy("k").count().withColumnRenamed("count", "n").withColumn("size", F.length("k"))
    for c in ("size", "other", "third"):
        df = lookup(df, table.withColumnRenamed("size", c), ["k"], weight="n", broadcast_rows=0)
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("ExistingRDD") == 1 and df.count() == 500


def test_lookup_checks_bytes_and_names(spark):
    wide = spark.createDataFrame([("x" * 1000, 1)] * 3, "k string, n int")
    assert is_small(wide) and not is_small(wide, most_bytes=2000) and not is_small(wide, rows=2)
    with pytest.raises(ValueError, match="exist already"):
        lookup(wide.withColumn("v", F.lit(1)), wide.withColumn("v", F.lit(2)), ["k"], weight="n")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_encoders_leave_columns_of_like_names_alone(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("tableprep.operators.encode.lookup", partial(lookup, broadcast_rows=broadcast_rows))
    rows = [(i, "ab"[i % 2], i % 3, f"s{i}", float(i), "xyz"[i % 3], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, category string, fold int, share string, encoded double, region string, y int")
    one = encode.fit_frequency(df, "region").apply(df)
    two = encode.fit_target(one, "category", "y", fold_key=["id"]).apply(one)
    three = encode.fit_ordinal(two, "share").apply(two)
    assert three.columns == df.columns
    got = {r["id"]: r for r in three.collect()}
    assert all((got[i]["fold"], got[i]["encoded"]) == (i % 3, float(i)) and abs(got[i]["region"] - 1 / 3) < 1e-9 for i in got)


def test_one_hot_has_the_form_that_is_asked_for(spark):
    for n in (99, 100, 101):
        df = spark.createDataFrame([(f"c{i:03d}",) for i in range(n)], "c string")
        assert len(encode.fit_one_hot(df, "c").apply(df).columns) == n
        assert encode.fit_one_hot(df, "c", output="vector").apply(df).columns == ["c_vector"]
    with pytest.raises(ValueError, match="more than 50"):
        encode.fit_one_hot(df, "c", limit=50)

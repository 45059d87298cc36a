"""Faults that show on larger tables or on tables written as folders."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tableprep.catalog import flows, logs
from tableprep.functions import hashing
from tableprep.operators import samples, split, text
from tableprep.plans import execute
from tableprep.sources.tables import list_table_files


@pytest.fixture
def long_ids(spark, tmp_path):
    rows = [(999, 0, "user"), (12345, 1, "user"), (23456, 0, "assistant"), (7, 4, "assistant")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_next_id_of_numbers_over_four_digits(spark, long_ids):
    assert [r[0] for r in logs.log_next_id(spark, long_ids).collect()] == ["assistant_23457"]


def test_next_ids_of_numbers_over_four_digits(spark, long_ids):
    assert sorted(map(tuple, logs.log_next_ids(spark, long_ids).collect())) == [("assistant", "assistant_23457"), ("user", "user_12346")]


def test_folders_written_as_tables_are_listed_with_their_rows(spark, tmp_path):
    spark.range(5).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(tmp_path / "parts.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "plain"))
    one = next((tmp_path / "plain").glob("part-*.parquet"))
    one.rename(tmp_path / "one.parquet")
    found = {r["file_name"]: (r["has_bytes"], r["row_count"]) for r in flows.list_files(spark, str(tmp_path)).collect()}
    assert found == {"many.parquet": (True, 5), "one.parquet": (True, 7), "parts.parquet": (True, 4)}
    sizes = {r["file_name"]: r["length"] for r in list_table_files(spark, str(tmp_path), recursive=True).collect()}
    assert sizes["many.parquet"] == sum(f.stat().st_size for f in (tmp_path / "many.parquet").glob("part-*"))


def test_shares_that_end_on_a_half_are_cut_where_decimals_say(spark):
    rows = spark.range(2855).withColumn("kind", F.lit("a"))  # 2855 * 0.7 is 1998.5, in doubles a little less
    done = split.stratified_split(rows, ["id"], "kind", split.split_shares(0.7, 0.15, 0.15))
    assert {r["split"]: r["count"] for r in done.groupBy("split").count().collect()} == {"train": 1999, "validation": 428, "test": 428}


def test_terms_are_counted_where_their_texts_are(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, "two"), (1, "one")], "doc_id long, text string")
    counted = text.term_counts(rows, ["doc_id"], "text")
    assert sorted(map(tuple, counted.collect())) == [(1, "one", 2), (1, "two", 2), (2, "two", 1)]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("term" in d for d in dealt)  # texts are shuffled, and not their terms


def test_samples_keep_whole_numbers_apart_beside_rows_without_an_order(spark):
    rows = [(2**53, "b"), (2**53 + 1, "a"), (None, "c")]  # as doubles the first two are one
    df = spark.createDataFrame(rows, "place long, name string").coalesce(1)
    assert [r["value"] for r in samples.ordered_samples(df, "place", 1).collect()] == ["b"]


def test_rows_written_after_the_split_have_only_columns_that_are_read(spark):
    rows = spark.createDataFrame([(i, i, float(i), "ab"[i % 2]) for i in range(40)], "id long, spare long, x double, y string")
    plan = {
        "plan_name": "p", "status": "executable", "task_type": "classification", "input_files": ["f"], "target_column": "y", "id_columns": ["id"],
        "feature_columns": ["x"], "numeric_scaling_plan": [{"columns": ["x"], "scaling": "standard"}],
        "split_strategy": {"strategy": "random", "train_size": 0.8, "test_size": 0.2}, "output_artifacts": [{"artifact_type": "train_data", "path": "o"}],
    }
    work = execute.prepare(rows, plan).rows
    assert sorted(work.columns) == ["split", "x", "y"] and work.count() == 40
    written = spark.read.parquet(work.inputFiles()[0].rsplit("/", 1)[0])
    assert sorted(written.columns) == ["split", "x", "y"]


@pytest.mark.parametrize("share", [0.8, 1 / 3, 0.5, 1e-10, 1 - 1e-12])
def test_digits_of_a_hash_tell_what_its_number_does(spark, share):
    drawn = spark.range(2000).select((hashing.unit_draw(F.col("id"), 7) < share).alias("a"), hashing.drawn_below(F.col("id"), 7, share).alias("b"))
    assert drawn.where("a <> b").count() == 0

"""Role and quality expectations on small inline tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tableprep.operators.profile import column_profile, table_profile
from tableprep.operators.quality import quality_issues, quality_summary
from tableprep.operators.roles import Task, column_roles, table_roles
from tableprep.plans.assess import assess


def rolled(df, task=None, **options):
    return table_roles(column_roles(column_profile(df, "t"), task, **options)).first()


def issues_of(df, task, **options):
    tables, columns = table_profile(df, "t"), column_profile(df, "t")
    roles = column_roles(columns, task)
    issues = quality_issues(tables, columns, roles, table_roles(roles), task, **options)
    return {r["issue_type"]: r for r in issues.collect()}, quality_summary(tables, issues).first()


def test_roles_of_a_labelled_table(spark):
    """Bee hives: an id, two measures, a label that the task names."""
    rows = [(f"H-{100 + i}", 31.5 + i / 4, i * 7 % 5, "lost" if i % 3 == 0 else "alive") for i in range(15)]
    df = spark.createDataFrame(rows, "hive_id string, brood_temp double, frames int, fate string")
    got = rolled(df, {"task_type": "classification", "input_mode": {"target_column": "fate"}})
    assert (got["target_column"], got["feature_columns"]) == ("fate", ["brood_temp", "frames"])
    assert (got["id_columns"], got["drop_columns"]) == (["hive_id"], ["hive_id"])


def test_roles_of_a_series(spark):
    rows = [(dt.datetime(2021, 3, 1, h), 0.5 * h, gate) for h in range(4) for gate in ("east", "west")]
    df = spark.createDataFrame(rows, "read_at timestamp, tide double, gate string")
    got = rolled(df, Task("forecasting", "tide", "read_at"))
    assert (got["target_column"], got["time_columns"], got["feature_columns"]) == ("tide", ["read_at"], ["gate"])


def test_candidates_are_reviewed(spark):
    df = spark.createDataFrame([(0.5 * i, "ab"[i % 2]) for i in range(6)], "thickness double, class string")
    got = rolled(df, Task("classification"))
    assert got["target_column"] is None and got["target_candidates"] == ["class"] and len(got["warnings"]) == 1


def test_free_text_and_code_columns(spark):
    rows = [("the left hinge squeaks when it rains", "H7"), ("paint came off near the lock", "H9"), ("nothing to see so far this year", "K1"), ("will not close since the storm", "K2")]
    roles = {r["name"]: r for r in column_roles(column_profile(spark.createDataFrame(rows, "remark string, part_code string"), "t")).collect()}
    assert (roles["remark"]["semantic_type"], roles["remark"]["recommended_use"]) == ("text", "use_text")
    assert roles["part_code"]["semantic_type"] == "id"


def test_clustering_has_no_warnings(spark):
    df = spark.createDataFrame([(0.1, 7), (0.4, 9), (0.2, 4), (0.9, 1)], "ash double, rings int")
    got = rolled(df, Task("clustering"))
    assert (got["feature_columns"], got["warnings"]) == (["ash", "rings"], [])


def test_explicit_argument_beats_task(spark):
    df = spark.createDataFrame([(1.5, "a"), (2.5, "b"), (4.0, "a")], "mass double, grade string")
    assert rolled(df, Task("classification", "mass"), target_column=" Grade ")["target_column"] == "grade"


def test_yes_no_text_is_categorical_and_float_flags_are_numeric(spark):
    df = spark.createDataFrame([("yes", 0.0, 1), ("no", 1.0, 0)], "member string, ratio double, flag int")
    kinds = {r["name"]: r["semantic_type"] for r in column_roles(column_profile(df, "t")).collect()}
    assert kinds == {"member": "categorical", "ratio": "numeric", "flag": "boolean"}


def test_target_gaps_block(spark):
    rows = [(0.3, "ripe"), (0.9, None), (0.4, "green"), (0.1, "green"), (0.6, None)]
    issues, summary = issues_of(spark.createDataFrame(rows, "sugar double, state string"), Task("classification", "state"))
    assert issues["target_missing_values"]["blocking"] and summary["blocking_issue_count"] == 1 and not summary["can_continue"]
    assert json.loads(issues["target_missing_values"]["evidence"]) == {"missing_rate": 0.4}


def test_single_class_blocks(spark):
    df = spark.createDataFrame([(0.5 * i, "sound") for i in range(7)], "load double, verdict string")
    issues, _ = issues_of(df, Task("classification", "verdict"))
    assert issues["target_single_class"]["blocking"]
    assert json.loads(issues["target_single_class"]["evidence"]) == {"unique_count": 1}


def test_imbalance_warns(spark):
    df = spark.createDataFrame([(0.5 * i, "leak" if i == 7 else "tight") for i in range(25)], "bar double, joint string")
    issues, summary = issues_of(df, Task("classification", "joint"))
    assert json.loads(issues["class_imbalance"]["evidence"]) == {"top_value": "tight", "top_rate": 0.96, "unique_count": 2}
    assert summary["can_continue"]


def test_several_faults_at_once(spark):
    rows = [("steel", None, "x"), ("steel", 2.0, "y"), ("steel", None, "x"), ("steel", None, "y"), ("steel", None, "x"), ("steel", None, "z")]
    df = spark.createDataFrame(rows, "alloy string, wear double, fault string")
    issues, _ = issues_of(df, Task("classification", "fault"), high_missing_rate=0.6)
    assert {"duplicate_rows", "constant_column", "high_missing_rate", "too_few_rows"} <= set(issues)
    assert json.loads(issues["duplicate_rows"]["evidence"]) == {"duplicate_row_count": 2, "duplicate_rate": 0.333333}


def test_no_target_and_no_time_block(spark):
    df = spark.createDataFrame([(0.5, 12), (0.7, 11), (0.2, 19)], "damp double, vents int")
    assert issues_of(df, Task("classification"))[0]["target_missing"]["blocking"]
    assert issues_of(df, Task("forecasting", "damp"))[0]["time_index_missing"]["blocking"]


def test_empty_missing_and_absent(spark):
    df = spark.createDataFrame([], "x int, target int")
    issues, summary = issues_of(df, Task("classification", "target"))
    assert {"empty_dataset", "all_missing_column"} <= set(issues) and not summary["can_continue"]
    df = spark.createDataFrame([(1, 2)], "x int, w int")
    issues, _ = issues_of(df, Task("regression", "price"))
    assert issues["target_not_found"]["columns"] == ["price"]


def test_time_text_that_does_not_parse(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "moment string, catch int")
    issues, _ = issues_of(df, Task("forecasting", "catch", "moment"))
    assert "time_index_not_parseable" in issues and "no_feature_columns" in issues


def test_many_values_and_leaking_id(spark):
    df = spark.createDataFrame([(f"Reef{i}", "ab"[i % 2]) for i in range(14)], "reef string, bleached string")
    columns = column_profile(df, "t")
    roles = column_roles(columns, Task("classification", "bleached"), high_cardinality_threshold=1.1, categorical_unique_threshold=5)
    rollup = table_roles(roles)
    assert [r["issue_type"] for r in quality_issues(table_profile(df, "t"), columns, roles, rollup).collect()].count("high_cardinality_categorical") == 1
    plain = column_roles(columns, high_cardinality_threshold=1.1)  # without a task both are features
    edited = plain.withColumn("role", F.when(F.col("name") == "reef", "identifier").otherwise(F.col("role")))
    found = quality_issues(table_profile(df, "t"), columns, edited, table_roles(plain))
    assert "possible_id_leakage" in [r["issue_type"] for r in found.collect()]


def test_profile_alone_can_be_checked(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "x int, y string")
    issues = quality_issues(table_profile(df, "t"), column_profile(df, "t"))
    assert {r["issue_type"] for r in issues.collect()} == {"too_few_rows", "all_missing_column"}


def test_assessment_yields_a_plan(spark):
    df = spark.createDataFrame([(f"H-{i}", 20.0 + i, "ab"[i % 2], "xy"[i // 3 % 2]) for i in range(60)], "hive_id string, brood_temp double, breed string, fate string")
    plan = assess(df, "the keeper's hives", Task("classification", "fate")).plan("the keeper's hives", ["hives.csv"])
    assert plan["status"] == "executable" and plan["target_column"] == "fate"
    assert plan["feature_columns"] == ["brood_temp", "breed"] and plan["id_columns"] == ["hive_id"]
    assert plan["categorical_encoding_plan"] == [{"columns": ["breed"], "encoding": "one_hot"}]
    assert plan["split_strategy"]["stratify_column"] == "fate"


@pytest.mark.parametrize("task", [Task("classification"), Task("forecasting", "load")])
def test_unready_tables_need_information(spark, task):
    df = spark.createDataFrame([(20.0 + i, "ab"[i % 2]) for i in range(60)], "load double, span string")
    plan = assess(df, "t", task).plan("t", ["t.csv"])
    assert plan["status"] == "need_info" and plan["user_facing_response"]

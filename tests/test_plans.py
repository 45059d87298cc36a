"""Plan documents: the rules, and carrying plans out."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from tableprep.operators.roles import Task
from tableprep.plans.assess import assess
from tableprep.plans.checks import plan_conflicts, plan_errors
from tableprep.plans.execute import check_plan, column_actions, load_preprocessor, prepare
from tableprep.sources import sinks

VALID = {
    "plan_name": "spoiled crates", "status": "executable", "task_type": "classification", "input_files": ["orchard.csv"],
    "target_column": "spoiled", "id_columns": ["id"], "feature_columns": ["weight", "variety"], "drop_columns": [],
    "missing_value_plan": [{"columns": ["weight"], "strategy": "median", "reason": "numeric"}],
    "categorical_encoding_plan": [{"columns": ["variety"], "encoding": "one_hot", "handle_unknown": "ignore"}],
    "numeric_scaling_plan": [{"columns": ["weight"], "scaling": "standard"}],
    "split_strategy": {"strategy": "stratified", "train_size": 0.6, "validation_size": 0.15, "test_size": 0.25, "stratify_column": "spoiled", "random_state": 42},
    "output_artifacts": [{"artifact_type": "train_data", "path": "out/train"}],
    "quality_issues_to_handle": [], "assumptions": [], "warnings": [], "user_facing_response": "", "downstream_notes": {},
}


def changed(**changes):
    plan = copy.deepcopy(VALID)
    plan.update(changes)
    return plan


INVALID = {
    "target": (changed(target_column=None), "requires target_column"),
    "time": (changed(task_type="forecasting"), "requires time_column"),
    "constant": (changed(missing_value_plan=[{"columns": ["weight"], "strategy": "constant"}]), "requires fill_value"),
    "stratified": (changed(split_strategy={"strategy": "stratified"}), "requires stratify_column"),
    "time_based": (changed(split_strategy={"strategy": "time_based"}), "requires time_column"),
    "sizes": (changed(split_strategy={"strategy": "random", "train_size": 1.5}), "between 0 and 1"),
    "sum": (changed(split_strategy={"strategy": "random", "train_size": 0.9, "test_size": 0.2}), "more than 1"),
    "need_info": (changed(status="need_info"), "requires user_facing_response"),
    "rejected": (changed(status="rejected"), "requires user_facing_response"),
    "extra": (changed(surprise=1), "unknown field"),
    "inner extra": (changed(numeric_scaling_plan=[{"columns": ["weight"], "scaling": "log", "x": 1}]), "unknown field"),
    "vocabulary": (changed(numeric_scaling_plan=[{"columns": ["weight"], "scaling": "cubic"}]), "not in its vocabulary"),
    "no columns": (changed(text_processing_plan=[{"columns": [], "method": "drop"}]), "columns cannot be empty"),
    "blank column": (changed(text_processing_plan=[{"columns": [" "], "method": "drop"}]), "columns cannot be empty"),
    "blank action": (changed(column_actions=[{"columns": ["a"], "action": " "}]), "action cannot be empty"),
    "no features": (changed(feature_columns=[]), "requires feature_columns"),
    "no artifacts": (changed(output_artifacts=[]), "requires output_artifacts"),
    "blank path": (changed(output_artifacts=[{"artifact_type": "other", "path": ""}]), "path cannot be empty"),
    "blank name": (changed(plan_name=" "), "plan_name cannot be empty"),
}

ONE = [{"columns": ["weight"], "strategy": "median"}]
SPLIT = VALID["split_strategy"]
WRONG_KINDS = {
    "plan_name is not a text": changed(plan_name=5),
    "user_facing_response is not a text": changed(user_facing_response=None),
    "target_column is not a text": changed(target_column=["spoiled"]),
    "assumptions is not a list of texts": changed(assumptions="not a list"),
    "warnings is not a list of texts": changed(warnings=["a", 1]),
    "drop_columns is not a list of texts": changed(drop_columns=None),
    "missing_value_plan is not a list of objects": changed(missing_value_plan="fill"),
    "numeric_scaling_plan is not a list of objects": changed(numeric_scaling_plan=["standard"]),
    "downstream_notes is not an object": changed(downstream_notes=[]),
    "split_strategy: train_size is not a number": changed(split_strategy={**SPLIT, "train_size": "lots"}),
    "split_strategy: random_state is not a whole number": changed(split_strategy={**SPLIT, "random_state": "abc"}),
    "split_strategy: random_state is not a whole number ": changed(split_strategy={**SPLIT, "random_state": 1.5}),
    "categorical_encoding_plan: handle_unknown is not a text": changed(categorical_encoding_plan=[{"columns": ["variety"], "encoding": "one_hot", "handle_unknown": 5}]),
    "categorical_encoding_plan: params is not an object": changed(categorical_encoding_plan=[{"columns": ["variety"], "encoding": "one_hot", "params": [1]}]),
    "missing_value_plan: columns is not a list of texts": changed(missing_value_plan=[{"columns": ["weight", 3], "strategy": "median"}]),
    "missing_value_plan: reason is not a text": changed(missing_value_plan=[*ONE, {**ONE[0], "reason": {"why": 1}}]),
    "column_actions: action is not a text": changed(column_actions=[{"columns": ["weight"], "action": 7}]),
    "output_artifacts: required is not true or false": changed(output_artifacts=[{"artifact_type": "train_data", "path": "p", "required": "maybe"}]),
    "output_artifacts: path is not a text": changed(output_artifacts=[{"artifact_type": "train_data", "path": 9}]),
}
RIGHT_KINDS = {
    "sizes as texts": changed(split_strategy={**SPLIT, "train_size": "0.6"}), "state as text": changed(split_strategy={**SPLIT, "random_state": "7"}),
    "whole state": changed(split_strategy={**SPLIT, "random_state": 7.0}), "no state": changed(split_strategy={**SPLIT, "random_state": None}),
    "no time": changed(time_column=None), "flag as text": changed(output_artifacts=[{"artifact_type": "train_data", "path": "p", "required": "no"}]),
    "any fill": changed(missing_value_plan=[{"columns": ["weight"], "strategy": "constant", "fill_value": [1]}]),
    "notes": changed(downstream_notes={"model": ["a"]}), "params": changed(numeric_scaling_plan=[{"columns": ["weight"], "scaling": "log", "params": {}}]),
}


def test_kinds_of_values(spark):
    documents = {**{k: json.dumps(p) for k, p in WRONG_KINDS.items()}, **{k: json.dumps(p) for k, p in RIGHT_KINDS.items()}}
    df = spark.createDataFrame(list(documents.items()), "name string, document string")
    errors = {r["name"]: r["errors"] for r in plan_errors(df, "document").collect()}
    assert {k: errors[k] for k in RIGHT_KINDS} == {k: [] for k in RIGHT_KINDS}
    assert {k: errors[k] for k in WRONG_KINDS} == {k: [k.strip()] for k in WRONG_KINDS}


def test_rules(spark):
    documents = {"valid": json.dumps(VALID), **{k: json.dumps(p) for k, (p, _) in INVALID.items()}, "broken": "{oops", "list": "[1]"}
    df = spark.createDataFrame(list(documents.items()), "name string, document string")
    errors = {r["name"]: r["errors"] for r in plan_errors(df, "document").collect()}
    assert errors["valid"] == []
    assert errors["broken"] == ["not a JSON object"] and errors["list"] == ["not a JSON object"]
    for name, (_, text) in INVALID.items():
        assert len(errors[name]) == 1 and text in errors[name][0], (name, errors[name])
    with pytest.raises(ValueError, match="requires target_column"):
        check_plan(spark, INVALID["target"][0])


def test_conflicts(spark):
    plan = changed(feature_columns=["weight", "spoiled", "id", "ripeness"])
    columns = spark.createDataFrame([("id",), ("weight",), ("variety",), ("spoiled",)], "name string")
    found = plan_conflicts(spark.createDataFrame([(1, json.dumps(plan))], "n int, document string"), "document", "n", columns)
    assert sorted((r["problem"], r["name"]) for r in found.collect()) == [
        ("id_in_features", "id"), ("target_in_features", "spoiled"), ("unknown_column", "ripeness"),
    ]


@pytest.fixture(scope="module")
def crates(spark):
    return spark.sql(
        "SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE 20.0D + id % 40 END AS weight, CASE WHEN id % 10 < 7 THEN 'x' ELSE 'y' END AS variety, "
        "cast(id % 2 AS int) AS spoiled, timestamp'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS t FROM range(200)"
    )


def test_prepare_and_write(spark, crates, tmp_path):
    done = prepare(crates, VALID)
    assert done.rows.columns == ["weight", "variety_x", "variety_y", "spoiled", "split"]
    rows = done.rows.collect()
    assert len(rows) == 200 and all(r["weight"] is not None and r["variety_x"] + r["variety_y"] == 1 for r in rows)
    train = [r["weight"] for r in rows if r["split"] == "train"]
    assert len(train) == 120 and abs(sum(train)) < 1e-9
    done.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == 200
    features = {r["feature"]: r["transform"] for r in spark.read.json(str(tmp_path / "out/feature_report")).collect()}
    assert features["variety_x"] == "one_hot"
    held = {r["path"]: r["exists"] for r in sinks.artifact_inventory(
        spark, [{"artifact_type": "train_data", "path": "data/split=train"}, {"artifact_type": "other", "path": "gone"}], str(tmp_path / "out")
    ).collect()}
    assert held == {"data/split=train": True, "gone": False}


@pytest.mark.parametrize("changes", [
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "target"}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "hashing", "params": {"buckets": 8}}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "ordinal"}], "numeric_scaling_plan": [{"columns": ["weight"], "scaling": "robust"}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "frequency"}], "split_strategy": {"strategy": "none"}},
    {"missing_value_plan": [{"columns": ["weight"], "strategy": "drop_rows"}], "split_strategy": {"strategy": "random", "train_size": 0.5}},
    {"feature_columns": ["t", "variety"], "datetime_processing_plan": [{"columns": ["t"], "method": "cyclical"}]},
    {"text_processing_plan": [{"columns": ["variety"], "method": "tfidf"}], "categorical_encoding_plan": []},
    {"time_column": "t", "missing_value_plan": [{"columns": ["weight"], "strategy": "bfill"}], "id_columns": [], "split_strategy": {"strategy": "time_based", "time_column": "t", "train_size": 0.8}},
])
def test_plan_variants_keep_every_row(crates, changes):
    plan = changed(**changes)
    done = prepare(crates, plan)
    dropping = plan["missing_value_plan"][0]["strategy"] == "drop_rows"
    assert done.rows.count() == (160 if dropping else 200)
    assert "spoiled" in done.rows.columns and "split" in done.rows.columns


def test_custom_steps(crates):
    plan = changed(numeric_scaling_plan=[{"columns": ["weight"], "scaling": "custom"}])
    done = prepare(crates, plan, functions={"numeric_scaling_plan": lambda df: df.withColumn("weight", F.lit(1.0))})
    assert done.rows.select("weight").distinct().count() == 1


def test_unready_plans_do_not_run(crates):
    with pytest.raises(ValueError, match="not executable"):
        prepare(crates, changed(status="need_info", user_facing_response="Which crates count as spoiled?"))


def test_column_actions(crates):
    done, failed = column_actions(crates, [
        {"columns": ["t"], "action": "drop"}, {"columns": ["variety"], "action": "rename", "params": {"variety": "type"}},
        {"columns": ["spoiled"], "action": "cast", "params": {"type": "string"}},
    ])
    assert done.columns == ["id", "weight", "type", "spoiled"] and failed.first()["failed_casts"] == 0
    with pytest.raises(ValueError, match="unknown column action"):
        column_actions(crates, [{"columns": ["t"], "action": "explode"}])


def test_default_plan_runs(crates):
    plan = assess(crates, "crates", Task("classification", "spoiled")).plan("crates", ["yard.csv"])
    done = prepare(crates, plan)
    assert done.rows.count() == 200 and "weight" in done.rows.columns


def test_content_hash_ignores_order(crates):
    assert sinks.content_hash(crates).first() == sinks.content_hash(crates.repartition(7).orderBy("weight")).first()
    other = crates.withColumn("spoiled", F.expr("CASE WHEN id = 3 THEN 7 ELSE spoiled END"))
    assert sinks.content_hash(crates).first() != sinks.content_hash(other).first()
    assert sinks.content_hash(crates.union(crates)).first() != sinks.content_hash(crates.limit(0)).first()


def test_steps_keep_what_they_make(crates):
    plan = changed(
        categorical_encoding_plan=[], numeric_scaling_plan=[], text_processing_plan=[{"columns": ["variety"], "method": "embedding"}],
        missing_value_plan=[{"columns": ["weight"], "strategy": "custom"}],
    )
    functions = {
        "embedding": lambda df: df.withColumn("vector", F.array(F.lit(1.0))).drop("variety"),
        "missing_value_plan": lambda df: df.withColumn("weight_known", F.col("weight").isNotNull()),
    }
    assert prepare(crates, plan, functions=functions).rows.columns == ["weight", "weight_known", "vector", "spoiled", "split"]


def test_renamed_features_stay_and_unknown_ones_raise(crates):
    renamed = changed(column_actions=[{"columns": ["variety"], "action": "rename", "params": {"variety": "sort"}}])
    assert prepare(crates, renamed).rows.columns == ["weight", "sort_x", "sort_y", "spoiled", "split"]
    for bad in ({"feature_columns": ["weight", "ripeness"]}, {"numeric_scaling_plan": [{"columns": ["hight"], "scaling": "standard"}]}):
        with pytest.raises(ValueError, match="does not have"):
            prepare(crates, changed(**bad))


def test_fills_keep_to_entity_and_split(spark):
    rows = [("b", i, None if i < 3 else 100.0 + i) for i in range(10)] + [("a", i, 1.0 + i if i != 7 else None) for i in range(10)]
    df = spark.createDataFrame([(s, f"2024-01-{i + 1:02d}", v, i % 2) for s, i, v in rows], "store string, day string, v double, y int")
    df = df.withColumn("day", F.to_timestamp("day"))
    base = dict(
        id_columns=["store"], drop_columns=["store"], feature_columns=["v"], target_column="y", time_column="day", categorical_encoding_plan=[],
        numeric_scaling_plan=[], split_strategy={"strategy": "time_based", "time_column": "day", "train_size": 0.7, "test_size": 0.3},
    )
    ahead = changed(**base, missing_value_plan=[{"columns": ["v"], "strategy": "ffill"}])
    got = {(r["v"], r["day"].day) for r in prepare(df, ahead, key=["store", "day"]).rows.collect() if r["v"] is None or r["v"] > 50}
    assert {d for v, d in got if v is None} >= {1, 2, 3}
    back = changed(**base, missing_value_plan=[{"columns": ["v"], "strategy": "bfill"}])
    late = spark.createDataFrame([("a", f"2024-01-{i + 1:02d}", float(i) if i > 6 else None, 0) for i in range(10)], "store string, day string, v double, y int")
    rows = prepare(late.withColumn("day", F.to_timestamp("day")), back, key=["store", "day"]).rows.collect()
    assert all(r["v"] is None for r in rows if r["split"] == "train") and all(r["v"] is not None for r in rows if r["split"] == "test")


def test_resampled_plans_keep_aggregates_and_entities(crates):
    plan = changed(
        id_columns=["variety"], feature_columns=["weight"], time_column="t", split_strategy={"strategy": "none"}, categorical_encoding_plan=[], numeric_scaling_plan=[],
        datetime_processing_plan=[{"columns": ["t"], "method": "resample", "params": {"unit": "day", "aggregates": {"rows": "count(*)", "mean_weight": "avg(weight)"}}}],
    )
    done = prepare(crates, plan, key=["id"]).rows
    assert done.columns == ["variety", "t", "rows", "mean_weight", "split"]
    assert done.agg(F.sum("rows")).first()[0] == 200 and done.select("variety").distinct().count() == 2


@pytest.mark.parametrize("changes", [
    {}, {"missing_value_plan": [{"columns": ["weight", "variety"], "strategy": "mode"}]},
    {"missing_value_plan": [{"columns": ["weight"], "strategy": "constant", "fill_value": 7}], "numeric_scaling_plan": [{"columns": ["weight"], "scaling": "log"}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "hashing", "params": {"buckets": 8}}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "one_hot", "params": {"output": "vector"}}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "ordinal"}], "numeric_scaling_plan": [{"columns": ["weight"], "scaling": "robust"}]},
    {"categorical_encoding_plan": [{"columns": ["variety"], "encoding": "frequency"}], "missing_value_plan": [{"columns": ["weight"], "strategy": "drop_rows"}]},
    {"feature_columns": ["t", "variety"], "datetime_processing_plan": [{"columns": ["t"], "method": "cyclical"}]},
    {"feature_columns": ["t", "weight"], "datetime_processing_plan": [{"columns": ["t"], "method": "extract_parts"}], "drop_columns": ["variety"], "categorical_encoding_plan": []},
    {"text_processing_plan": [{"columns": ["variety"], "method": "tfidf"}], "categorical_encoding_plan": []},
    {"numeric_scaling_plan": [{"columns": ["weight"], "scaling": "custom"}], "column_actions": [{"columns": ["variety"], "action": "rename", "params": {"variety": "sort"}}]},
])
def test_steps_read_back_do_the_same(spark, crates, tmp_path, changes):
    functions = {"numeric_scaling_plan": lambda df: df.withColumn("weight", F.col("weight") * 2)}
    done = prepare(crates, changed(**changes), functions=functions)
    done.write_preprocessor(str(tmp_path / "steps"))
    again = load_preprocessor(spark, str(tmp_path / "steps"), functions).apply(crates)
    want = done.rows.drop("split")
    assert again.columns == want.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
    unlabelled = load_preprocessor(spark, str(tmp_path / "steps"), functions).apply(crates.drop("spoiled"))
    assert unlabelled.columns == [c for c in want.columns if c != "spoiled"] and unlabelled.count() == want.count()


def test_new_rows_get_the_target_mean_over_all_folds(spark, crates, tmp_path):
    done = prepare(crates, changed(categorical_encoding_plan=[{"columns": ["variety"], "encoding": "target"}]))
    done.write_preprocessor(str(tmp_path / "steps"))
    rows = load_preprocessor(spark, str(tmp_path / "steps")).apply(crates.drop("spoiled").withColumn("variety", F.when(F.col("id") > 3, F.col("variety"))))
    held_out = {r["variety"] for r in done.rows.where("split = 'test'").collect()}
    overall = next(float(v) for c, s, n, v in done.steps[1].facts + done.steps[0].facts if n == "overall_mean")
    assert {r["variety"] for r in rows.collect()} == {*held_out, overall}


def test_new_rows_may_lack_the_target_but_no_feature(spark, crates, tmp_path):
    plan = changed(missing_value_plan=[{"columns": ["spoiled"], "strategy": "drop_rows"}, {"columns": ["weight"], "strategy": "mean"}, {"columns": ["spoiled"], "strategy": "mode"}])
    done = prepare(crates, plan)
    done.write_preprocessor(str(tmp_path / "steps"))
    again = load_preprocessor(spark, str(tmp_path / "steps"))
    rows = again.apply(crates.drop("spoiled"))
    assert rows.columns == ["weight", "variety_x", "variety_y"] and rows.count() == 200
    with pytest.raises(ValueError, match="lack features"):
        again.apply(crates.drop("variety"))


def test_custom_steps_must_be_brought_along(spark, crates, tmp_path):
    plan = changed(numeric_scaling_plan=[{"columns": ["weight"], "scaling": "custom"}])
    prepare(crates, plan, functions={"numeric_scaling_plan": lambda df: df}).write_preprocessor(str(tmp_path / "steps"))
    with pytest.raises(ValueError, match="need a function for numeric_scaling_plan"):
        load_preprocessor(spark, str(tmp_path / "steps"))


def test_independent_steps_are_fitted_together(spark, crates):
    """However many columns a level has, it asks as often."""
    def jobs(columns):
        df = crates.select("*", *[F.col("weight").alias(f"w{i}") for i in range(columns)], *[F.col("variety").alias(f"v{i}") for i in range(columns)])
        numbers, texts = [f"w{i}" for i in range(columns)], [f"v{i}" for i in range(columns)]
        plan = changed(
            feature_columns=[*numbers, *texts], missing_value_plan=[{"columns": numbers, "strategy": "mean"}, {"columns": texts, "strategy": "mode"}],
            categorical_encoding_plan=[{"columns": texts, "encoding": "one_hot"}], numeric_scaling_plan=[{"columns": numbers, "scaling": "standard"}],
            split_strategy={"strategy": "random", "train_size": 0.8, "test_size": 0.2},
        )
        tag = f"fit-{columns}"
        spark.sparkContext.setJobGroup(tag, tag)
        prepare(df, plan)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    assert jobs(6) <= jobs(1) <= 20

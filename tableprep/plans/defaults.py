"""The default plan: per-column treatment and plan header as expressions over roles and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed


def column_plan(columns: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per column: what to do about gaps, and how to encode, scale or unfold it."""
    counts = columns.select("dataset_name", "name", "non_null_count", "missing_count", "unique_count")
    joined = roles.join(F.broadcast(counts), ["dataset_name", "name"])
    role, meaning = F.col("role"), F.col("semantic_type")
    empty = F.col("non_null_count") == 0
    used = role.isin("feature", "time_index") & ~empty
    feature = (role == "feature") & ~empty
    gaps = F.col("missing_count") > 0
    constant = F.col("unique_count") <= 1
    high = meaning == "high_cardinality_categorical"
    missing = (
        F.when(empty, "drop_column")
        .when((role == "target") & gaps, "drop_rows")
        .when((role == "time_index") & gaps, "drop_rows")
        .when(feature & gaps & (meaning == "numeric"), "median")
        .when(feature & gaps & (meaning.isin("categorical", "boolean") | high), "mode")
        .otherwise("none")
    )
    encoding = (
        F.when(feature & (meaning == "categorical"), "one_hot")
        .when(feature & high, "frequency").otherwise("none")
    )
    dates = (
        F.when(used & (role == "time_index"), "sort_index")
        .when(feature & (meaning == "datetime"), "extract_parts").otherwise("none")
    )
    return joined.select(
        "dataset_name", "position", "name", "role", "semantic_type",
        (feature & ~constant).alias("is_feature"),
        ((F.col("recommended_use") == "drop") | empty | (feature & constant)).alias("is_dropped"),
        missing.alias("missing_strategy"), encoding.alias("encoding"),
        F.when(feature & (meaning == "numeric"), "standard").otherwise("none").alias("scaling"),
        F.when(feature & (meaning == "text"), "tfidf").otherwise("none").alias("text_method"),
        dates.alias("datetime_method"),
    )


def plan_header(rollup: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per dataset: status, target, time column and split strategy.

    A plan can run only when no issue blocks, a supervised task has its target, a forecast its
    time column, and features remain.
    """
    joined = rollup.join(F.broadcast(summary), "dataset_name")
    task = F.coalesce(F.col("task_type"), F.lit("unknown"))
    time: Column = F.get("time_columns", F.lit(0))
    ready = (
        F.col("can_continue")
        & ~(task.isin(*fixed.SUPERVISED_TASKS) & F.col("target_column").isNull())
        & ~((task == "forecasting") & time.isNull())
        & (F.size("feature_columns") > 0)
        & (task != "unknown")
    )
    split = (
        F.when(task == "classification", "stratified").when(task == "regression", "random")
        .when(task == "forecasting", "time_based").otherwise("none")
    )
    return joined.select(
        "dataset_name", F.when(ready, "executable").otherwise("need_info").alias("status"), task.alias("task_type"),
        "target_column", time.alias("time_column"), split.alias("split_strategy"), "blocking_issue_count", "recommended_actions",
    )


def default_plan(header: dict, columns: list[dict], input_files: list[str], output: str = "prepared") -> dict:
    """The plan document of one dataset, from its header and its column rows (one per column)."""
    rows = sorted(columns, key=lambda r: r["position"])

    def grouped(field: str, name: str) -> list[dict]:
        methods = dict.fromkeys(r[field] for r in rows if r[field] != "none")
        return [{"columns": [r["name"] for r in rows if r[field] == m], name: m} for m in methods]

    split: dict = {"strategy": header["split_strategy"], "random_state": fixed.DEFAULT_RANDOM_STATE}
    if header["split_strategy"] != "none":
        split |= {"train_size": 0.7, "validation_size": 0.15, "test_size": 0.15}
    if header["split_strategy"] == "stratified":
        split["stratify_column"] = header["target_column"]
    if header["split_strategy"] == "time_based":
        split["time_column"] = header["time_column"]
    document = {
        "plan_name": f"default plan for {header['dataset_name']}",
        "status": header["status"],
        "task_type": header["task_type"],
        "input_files": input_files,
        "target_column": header["target_column"],
        "time_column": header["time_column"],
        "id_columns": [r["name"] for r in rows if r["role"] == "identifier"],
        "feature_columns": [r["name"] for r in rows if r["is_feature"]],
        "drop_columns": [r["name"] for r in rows if r["is_dropped"]],
        "missing_value_plan": grouped("missing_strategy", "strategy"),
        "categorical_encoding_plan": grouped("encoding", "encoding"),
        "numeric_scaling_plan": grouped("scaling", "scaling"),
        "text_processing_plan": grouped("text_method", "method"),
        "datetime_processing_plan": grouped("datetime_method", "method"),
        "split_strategy": split,
        "output_artifacts": [
            {"artifact_type": "full_processed_data", "path": f"{output}/data"},
            {"artifact_type": "feature_report", "path": f"{output}/feature_report"},
            {"artifact_type": "preprocessor", "path": f"{output}/parameters"},
        ],
        "quality_issues_to_handle": list(dict.fromkeys(header["recommended_actions"] or [])),
    }
    if header["status"] != "executable":
        document["user_facing_response"] = " ".join(document["quality_issues_to_handle"]) or "More information is needed."
    return document

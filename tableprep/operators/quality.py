"""Quality rules as filters over the profile and role tables, which hold one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.functions.columns import ratio
from tableprep.operators.roles import Tasks, with_tasks

ISSUE_ORDER = tuple(fixed.ISSUE_TEXTS)


def quality_issues(
    tables: DataFrame,
    columns: DataFrame,
    roles: DataFrame | None = None,
    rollup: DataFrame | None = None,
    tasks: Tasks = None,
    *,
    by_dataset: bool = False,
    high_missing_rate: float = fixed.HIGH_MISSING_RATE,
    class_imbalance_rate: float = fixed.CLASS_IMBALANCE_RATE,
    min_rows_warning: int = fixed.MIN_ROWS_WARNING,
) -> DataFrame:
    """One row per issue, in rule order.

    `tables` and `columns` are the profiles, `roles` and `rollup` the inferred roles. The task
    type and target of the roles win over those of `tasks`.
    """
    context = with_tasks(tables.select("dataset_name"), tasks, by_dataset)
    if rollup is not None:
        inferred = rollup.select(
            "dataset_name", F.col("task_type").alias("role_task"), F.col("target_column").alias("role_target"),
            "feature_columns", "time_columns",
        )
        context = context.join(F.broadcast(inferred), "dataset_name", "left")
    else:
        none = F.lit(None)
        context = context.select(
            "*", none.cast("string").alias("role_task"), none.cast("string").alias("role_target"),
            none.cast("array<string>").alias("feature_columns"), none.cast("array<string>").alias("time_columns"),
        )
    context = context.select(
        "dataset_name", F.coalesce("role_task", "task_type").alias("task_type"),
        F.coalesce("role_target", "explicit_target").alias("target"), "feature_columns", "time_columns",
    )
    whole = tables.join(F.broadcast(context), "dataset_name")
    rows, copies = F.col("row_count"), F.col("duplicate_row_count")
    found = [
        _issue(whole.where(rows == 0), "empty_dataset", "error", evidence=F.struct(rows.alias("rows"))),
        _issue(
            whole.where((rows > 0) & (rows < min_rows_warning)), "too_few_rows", "warning", about=rows,
            evidence=F.struct(rows.alias("rows"), F.lit(min_rows_warning).alias("min_rows_warning")),
        ),
        _issue(
            whole.where(copies > 0), "duplicate_rows", "warning", about=copies,
            evidence=F.struct(copies.alias("duplicate_row_count"), ratio(copies, rows).alias("duplicate_rate")),
        ),
    ]

    name, rate, distinct = F.col("name"), F.col("missing_rate"), F.col("unique_count")
    present, missing = F.col("non_null_count") > 0, F.struct("missing_rate")
    if roles is not None:
        role_of = roles.select("dataset_name", "name", "role")
        profiled = columns.join(F.broadcast(role_of), ["dataset_name", "name"], "left")
    else:
        profiled = columns.withColumn("role", F.lit(None).cast("string"))
    found += [
        _issue(profiled.where(~present), "all_missing_column", "error", name, evidence=missing),
        _issue(profiled.where(present & (rate >= high_missing_rate)), "high_missing_rate", "warning", name, evidence=missing),
        _issue(
            profiled.where(present & (distinct <= 1) & ~F.col("role").eqNullSafe("target")),
            "constant_column", "warning", name, evidence=F.struct("unique_count"),
        ),
    ]
    if rollup is not None:
        found.append(_issue(whole.where(F.size("feature_columns") == 0), "no_feature_columns", "error"))

    target, task = F.col("target"), F.coalesce(F.col("task_type"), F.lit(""))
    supervised = whole.where(task.isin(*fixed.SUPERVISED_TASKS))
    named = supervised.where(target.isNotNull()).select("dataset_name", "task_type", "target")
    on_target = columns.join(
        F.broadcast(named.withColumnRenamed("target", "name")), ["dataset_name", "name"]
    )
    classes = on_target.where(task == "classification")
    top = F.get("top_values", F.lit(0))
    found += [
        _issue(supervised.where(target.isNull()), "target_missing", "error"),
        _issue(
            named.join(
                F.broadcast(columns.select("dataset_name", F.col("name").alias("target"))),
                ["dataset_name", "target"], "left_anti",
            ),
            "target_not_found", "error", target,
        ),
        _issue(on_target.where(rate > 0), "target_missing_values", "error", name, evidence=missing),
        _issue(classes.where(distinct < 2), "target_single_class", "error", name, evidence=F.struct("unique_count")),
        _issue(
            classes.where((distinct >= 2) & (top["rate"] >= class_imbalance_rate)), "class_imbalance", "warning", name,
            evidence=F.struct(top["value"].alias("top_value"), top["rate"].alias("top_rate"), "unique_count"),
        ),
    ]

    forecasts = whole.where(task == "forecasting")
    times = forecasts.select("dataset_name", F.explode("time_columns").alias("name"))
    found += [
        _issue(
            forecasts.where(F.coalesce(F.size("time_columns"), F.lit(0)) <= 0), "time_index_missing", "error"
        ),
        _issue(
            columns.join(F.broadcast(times), ["dataset_name", "name"]).where(~F.col("has_datetime_summary")),
            "time_index_not_parseable", "warning", name,
            evidence=F.struct(F.col("type_class").alias("pandas_type")),
        ),
    ]
    if roles is not None:
        in_features = rollup.select("dataset_name", "feature_columns") if rollup is not None else None
        found.append(_issue(
            roles.where(F.col("semantic_type") == "high_cardinality_categorical"),
            "high_cardinality_categorical", "warning", name, evidence=F.struct("role", "recommended_use"),
        ))
        if in_features is not None:
            leaking = roles.join(F.broadcast(in_features), "dataset_name").where(
                (F.col("role") == "identifier") & F.array_contains("feature_columns", name)
            )
            found.append(_issue(leaking, "possible_id_leakage", "warning", name, evidence=F.struct("semantic_type")))
    return reduce(DataFrame.unionByName, found)


def _issue(
    rows: DataFrame,
    issue_type: str,
    severity: str,
    column: Column | None = None,
    *,
    about: Column | None = None,
    evidence: Column | None = None,
) -> DataFrame:
    message, recommendation = fixed.ISSUE_TEXTS[issue_type]
    subject = column if column is not None else about
    # rules over the columns of one table keep the order missingness, constants, targets, risks
    order = F.lit(ISSUE_ORDER.index(issue_type))
    position = F.col("position") if "position" in rows.columns else F.lit(0)
    text = F.lit(message)
    if subject is not None:
        before, after = message.split("%s")
        text = F.concat(F.lit(before), subject.cast("string"), F.lit(after))
    return rows.select(
        "dataset_name",
        order.alias("rule_order"),
        position.alias("column_order"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"),
        (F.array(column) if column is not None else F.array().cast("array<string>")).alias("columns"),
        text.alias("message"),
        F.lit(recommendation).alias("recommendation"),
        F.lit(severity == "error").alias("blocking"),
        (F.to_json(evidence, {"ignoreNullFields": "false"}) if evidence is not None else F.lit("{}")).alias("evidence"),
    )


def _sequence() -> Column:
    """Place of an issue in its report: missingness and risk rules go column by column."""
    grouped = {
        "high_missing_rate": ISSUE_ORDER.index("all_missing_column"),
        "possible_id_leakage": ISSUE_ORDER.index("high_cardinality_categorical"),
    }
    rule = F.col("rule_order")
    for issue_type, first in grouped.items():
        rule = F.when(F.col("issue_type") == issue_type, first).otherwise(rule)
    return F.struct(rule.alias("rule"), "column_order", "rule_order")


def quality_summary(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per dataset: counts by severity, whether work can go on, and what to do next."""

    def advice(condition: Column) -> Column:
        listed = F.sort_array(
            F.collect_list(F.when(condition, F.struct(_sequence().alias("at"), F.col("recommendation").alias("text"))))
        )
        return F.transform(listed, lambda e: e["text"])

    severity, blocking = F.col("severity"), F.col("blocking")
    counted = issues.groupBy("dataset_name").agg(
        F.count_if(severity == "error").alias("error_count"),
        F.count_if(severity == "warning").alias("warning_count"),
        F.count_if(severity == "info").alias("info_count"),
        F.count_if(blocking).alias("blocking_issue_count"),
        advice(blocking).alias("must"),
        advice(severity == "warning").alias("may"),
    )
    joined = tables.select("dataset_name").join(F.broadcast(counted), "dataset_name", "left")
    zero = {c: 0 for c in ("error_count", "warning_count", "info_count", "blocking_issue_count")}
    none = F.array().cast("array<string>")
    return joined.na.fill(zero).select(
        "dataset_name", *zero,
        (F.col("blocking_issue_count") == 0).alias("can_continue"),
        F.coalesce(F.when(F.col("blocking_issue_count") > 0, F.col("must")).otherwise(F.col("may")), none)
        .alias("recommended_actions"),
    )

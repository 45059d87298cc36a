"""Column meanings and modelling roles as expressions over the column profile.

One job covers a whole catalog: every dataset_name may have its own task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep import fixed_values as fixed
from tableprep.functions.hashing import any_of


@dataclass(frozen=True)
class Task:
    """What is to be modelled: the task type and, where given, the target and time columns."""

    task_type: str | None = None
    target_column: str | None = None
    time_column: str | None = None

    @classmethod
    def of(cls, definition: "Task | Mapping[str, Any] | None") -> "Task":
        """From a task definition document."""
        if definition is None:
            return cls()
        if isinstance(definition, Task):
            return definition
        inputs = definition.get("input_mode") or {}
        return cls(definition.get("task_type"), inputs.get("target_column"), inputs.get("time_column"))


Tasks = Task | Mapping[str, Any] | None

TASK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("dataset_name", "task_type", "target_column", "time_column")]
)


def with_tasks(df: DataFrame, tasks: Tasks, by_dataset: bool = False) -> DataFrame:
    """Add task_type, explicit_target and explicit_time.

    `tasks` is one task for everything or, with by_dataset, one per dataset_name.
    """
    if by_dataset:
        rows = [(n, t.task_type, t.target_column or None, t.time_column or None)
                for n, t in ((n, Task.of(d)) for n, d in tasks.items())]
        table = df.sparkSession.createDataFrame(rows, TASK_SCHEMA).select(
            "dataset_name", "task_type", F.col("target_column").alias("explicit_target"),
            F.col("time_column").alias("explicit_time"),
        )
        return df.join(F.broadcast(table), "dataset_name", "left")
    task = Task.of(tasks)
    return df.withColumns({
        "task_type": F.lit(task.task_type).cast("string"),
        "explicit_target": F.lit(task.target_column or None).cast("string"),
        "explicit_time": F.lit(task.time_column or None).cast("string"),
    })


def same_name(left: Column, right: Column) -> Column:
    return F.coalesce(F.lower(F.trim(left)) == F.lower(F.trim(right)), F.lit(False))


def looks_binary(samples: Column) -> Column:
    """All samples lie within one of the known pairs."""
    texts = F.transform(samples, lambda v: F.lower(F.trim(v)))
    within = [
        F.size(F.array_except(texts, F.array(*[F.lit(v) for v in pair]))) == 0
        for pair in fixed.BINARY_PAIRS
    ]
    return (F.size(samples) > 0) & any_of(within)


def looks_like_text(samples: Column) -> Column:
    """Long on average, or often with a space inside."""
    count = F.size(samples)
    total = F.aggregate(samples, F.lit(0), lambda a, v: a + F.length(v))
    spaced = F.size(F.filter(samples, lambda v: F.instr(F.trim(v), " ") > 0))
    half = F.greatest(F.lit(1), F.floor(count / 2).cast("int"))
    return (count > 0) & ((total >= fixed.TEXT_AVERAGE_LENGTH * count) | (spaced >= half))


def semantic_type(unique_limit: int = fixed.CATEGORICAL_UNIQUE_THRESHOLD) -> Column:
    kind, samples = F.col("type_class"), F.col("sample_values")
    is_time = F.col("has_datetime_summary") | (kind == "datetime")
    is_number = kind.isin("integer", "float", "numeric")
    is_text = (kind == "string") & looks_like_text(samples)
    return (
        F.when(is_time, "datetime")
        .when(kind == "boolean", "boolean")
        .when(is_number & looks_binary(samples), "boolean")
        .when(is_number, "numeric")
        .when(is_text, "text")
        .when(kind.isin("string", "object") & (F.col("unique_count") > unique_limit), "high_cardinality_categorical")
        .when(kind.isin("string", "object"), "categorical")
        .otherwise("unknown")
    )


def column_roles(
    columns: DataFrame,
    tasks: Tasks = None,
    *,
    by_dataset: bool = False,
    target_column: str | None = None,
    time_column: str | None = None,
    high_cardinality_threshold: float = fixed.HIGH_CARDINALITY_THRESHOLD,
    categorical_unique_threshold: int = fixed.CATEGORICAL_UNIQUE_THRESHOLD,
) -> DataFrame:
    """One row per column: semantic_type, role, recommended_use, confidence, reasons.

    A target or time column given here beats the one of the task.
    """
    df = with_tasks(columns, tasks, by_dataset)
    if target_column:
        df = df.withColumn("explicit_target", F.lit(target_column))
    if time_column:
        df = df.withColumn("explicit_time", F.lit(time_column))

    name = F.lower("name")
    all_unique = (
        F.col("type_class").isin("string", "object")
        & (F.col("row_count") >= fixed.ID_MIN_ROWS)
        & (F.col("unique_count") == F.col("row_count"))
        & (F.col("unique_rate") >= high_cardinality_threshold)
    )
    task = F.coalesce(F.col("task_type"), F.lit(""))
    rule = (
        F.when(same_name(F.col("name"), F.col("explicit_target")), "target")
        .when(same_name(F.col("name"), F.col("explicit_time")), "time")
        .when(F.col("has_datetime_summary") | (F.col("type_class") == "datetime"), "datetime")
        .when(name.rlike(fixed.ID_NAME_PATTERN) | all_unique, "id")
        .when(task.isin(*fixed.SUPERVISED_TASKS) & name.rlike(fixed.TARGET_NAME_PATTERN), "candidate")
        .otherwise("feature")
    )
    df = df.withColumns({"rule": rule, "meaning": semantic_type(categorical_unique_threshold)})
    forecasting = (F.col("rule") == "datetime") & (task == "forecasting")
    feature = F.col("rule") == "feature"

    def pick(**values: Any) -> Column:
        chosen = F.lit(None)
        for key, value in values.items():
            chosen = F.when(F.col("rule") == key, value).otherwise(chosen)
        return chosen

    by_meaning = F.col("meaning")
    meaning = pick(time="datetime", datetime="datetime", id="id", target=by_meaning, candidate=by_meaning, feature=by_meaning)
    role = pick(
        target="target", time="time_index", id="identifier", candidate="target_candidate", feature="feature",
        datetime=F.when(forecasting, "time_index").otherwise("feature"),
    )
    use = pick(
        target="target", time="time_index", id="drop", candidate="review",
        datetime=F.when(forecasting, "time_index").otherwise("use"),
        feature=F.when(by_meaning == "text", "use_text")
        .when(by_meaning.isin("unknown", "high_cardinality_categorical"), "review").otherwise("use"),
    )
    confidence = pick(
        target=F.lit(1.0), time=F.lit(1.0), datetime=F.lit(0.9), id=F.lit(0.9), candidate=F.lit(0.65),
        feature=F.when(by_meaning == "unknown", 0.4).when(by_meaning == "text", 0.7)
        .when(by_meaning == "high_cardinality_categorical", 0.65).otherwise(0.8),
    )
    typed = F.concat(F.lit(fixed.REASON_TYPE), F.col("type_class"))
    reasons = F.array_compact(F.array(
        pick(target=fixed.REASON_EXPLICIT_TARGET, time=fixed.REASON_EXPLICIT_TIME,
             datetime=fixed.REASON_DATETIME, id=fixed.REASON_ID, candidate=typed, feature=typed),
        F.when(F.col("rule") == "candidate", fixed.REASON_CANDIDATE),
        F.when(feature & (by_meaning == "unknown"), fixed.REASON_UNKNOWN),
        F.when(feature & (by_meaning == "text"), fixed.REASON_TEXT),
        F.when(feature & (by_meaning == "high_cardinality_categorical"), fixed.REASON_HIGH_CARDINALITY),
        F.when(F.col("missing_rate") > 0, F.concat(F.lit(fixed.REASON_MISSING), F.col("missing_rate").cast("string"))),
    ))
    return df.select(
        "dataset_name", "position", "name", meaning.alias("semantic_type"), role.alias("role"),
        use.alias("recommended_use"), confidence.alias("confidence"), reasons.alias("reasons"),
        "task_type", "explicit_target", "explicit_time",
    )


def table_roles(roles: DataFrame) -> DataFrame:
    """One row per dataset: the column lists in table order, the target and the warnings."""

    def names(condition: Column) -> Column:
        listed = F.sort_array(F.collect_list(F.when(condition, F.struct("position", "name"))))
        return F.transform(listed, lambda e: e["name"])

    role = F.col("role")
    rolled = roles.groupBy("dataset_name", "task_type", "explicit_target", "explicit_time").agg(
        names(role == "feature").alias("feature_columns"),
        names(role == "target").alias("target_columns"),
        names(role == "target_candidate").alias("target_candidates"),
        names(role == "identifier").alias("id_columns"),
        names(role == "time_index").alias("time_columns"),
        names(F.col("recommended_use") == "drop").alias("drop_columns"),
        F.bool_or(same_name(F.col("name"), F.col("explicit_target"))).alias("has_target"),
        F.bool_or(same_name(F.col("name"), F.col("explicit_time"))).alias("has_time"),
    )
    task = F.coalesce(F.col("task_type"), F.lit(""))
    no_target = task.isin("classification", "regression") & (F.size("target_columns") == 0)
    candidates = F.size("target_candidates") > 0
    warnings = F.array_compact(F.array(
        F.when(F.col("explicit_target").isNotNull() & ~F.col("has_target"),
               F.concat(F.lit(fixed.WARN_TARGET_ABSENT), F.col("explicit_target"))),
        F.when(F.col("explicit_time").isNotNull() & ~F.col("has_time"),
               F.concat(F.lit(fixed.WARN_TIME_ABSENT), F.col("explicit_time"))),
        F.when(no_target & candidates, fixed.WARN_REVIEW_CANDIDATES),
        F.when(no_target & ~candidates, fixed.WARN_NO_TARGET),
        F.when((task == "forecasting") & (F.size("time_columns") == 0), fixed.WARN_NO_TIME),
        F.when((task == "clustering") & (F.size("target_columns") > 0), fixed.WARN_CLUSTER_TARGET),
    ))
    return rolled.select(
        "dataset_name", "task_type", "feature_columns", F.get("target_columns", F.lit(0)).alias("target_column"),
        "target_candidates", "id_columns", "time_columns", "drop_columns", warnings.alias("warnings"),
        "explicit_target", "explicit_time",
    )

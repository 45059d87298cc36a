"""The gate for task definitions: which may be modelled, which need information or confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed

TASK_SCHEMA = (
    "task_name string, task_type string, decision string, should_model boolean, problem_statement string, "
    "input_mode struct<data_type:string,required_inputs:array<string>,optional_inputs:array<string>,"
    "target_column:string,id_columns:array<string>,time_column:string,data_granularity:string,"
    "known_data_sources:array<string>>, "
    "output_mode struct<prediction_type:string,target_description:string,output_format:string>, "
    "evaluation struct<primary_metric:string,secondary_metrics:array<string>,validation_strategy:string,"
    "metric_reasoning:string>, "
    "assumptions array<string>, missing_information string, user_facing_response string"
)
GAPS_SCHEMA = "critical array<string>, optional array<string>"
KEYS_SCHEMA = ", ".join(f"{name} map<string,string>" for name in fixed.TASK_INNER_FIELDS)


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def upgrade_missing(raw: Column) -> Column:
    """missing_information as {critical, optional}; a bare list means critical."""
    wrapped = F.when(F.ltrim(raw).startswith("["), F.concat(F.lit('{"critical": '), raw, F.lit("}"))).otherwise(raw)
    return F.from_json(wrapped, GAPS_SCHEMA)


def parse_tasks(df: DataFrame, document: str) -> DataFrame:
    """Add the fields of each task definition, defaults filled in, and what makes it inconsistent.

    An unknown task type is rejected, and an accepted task with optional gaps waits for
    confirmation, before any gate rule is looked at. Blank names and statements, unknown fields and
    words outside the vocabularies make a document inconsistent too. Where a decision leaves the
    response blank it gets the standard text, and an accepted task with optional gaps always does.
    """
    task = F.col("__task")
    parsed = df.withColumns({
        "__task": F.from_json(F.col(document), TASK_SCHEMA), "__keys": F.from_json(F.col(document), KEYS_SCHEMA),
        "__own": F.json_object_keys(F.col(document)),
    })
    fields = parsed.withColumns({
        "__fault": _fault(task, F.col("__keys"), F.col("__own")),
        "task_type": task["task_type"],
        "stated_decision": F.when(task["task_type"] == "unknown", "rejected").otherwise(task["decision"]),
        "__gaps": upgrade_missing(task["missing_information"]),
        "input_mode": task["input_mode"], "output_mode": task["output_mode"], "evaluation": task["evaluation"],
        "assumptions": _list(task["assumptions"]), "response": _text(task["user_facing_response"]),
    }).withColumn(
        "gaps", F.struct(_list(F.col("__gaps.critical")).alias("critical"), _list(F.col("__gaps.optional")).alias("optional"))
    ).drop("__task", "__gaps", "__keys", "__own")
    decision = F.col("stated_decision")
    critical, optional = F.size("gaps.critical") > 0, F.size("gaps.optional") > 0
    waits = (decision == "need_confirmation")
    problem = (
        F.when(task_missing(), "not a task definition").when(F.col("__fault").isNotNull(), F.col("__fault"))
        .when((decision == "accepted") & critical, "accepted with critical gaps")
        .when((decision == "need_info") & ~critical, "need_info without critical gaps")
        .when(waits & critical, "need_confirmation with critical gaps")
        .when(waits & ~optional, "need_confirmation without optional gaps")
    )
    settled = F.when((decision == "accepted") & optional, "need_confirmation").otherwise(decision)
    texts = fixed.TASK_RESPONSES
    standard = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    response = (
        F.when((decision == "accepted") & optional, texts["optional"])
        .when(F.trim("response") == "", F.coalesce(standard[settled], F.col("response"))).otherwise(F.col("response"))
    )
    return fields.withColumns({
        "problem": problem, "decision": settled, "response": response,
        "task_type": F.when(settled == "rejected", "unknown").otherwise(F.col("task_type")),
        "should_model": (settled == "accepted") & problem.isNull(),
    }).drop("stated_decision", "__fault")


def _fault(task: Column, keys: Column, own: Column) -> Column:
    """The first rule of form that a document breaks, null if none."""
    def outside(column: Column, vocabulary: tuple[str, ...]) -> Column:
        return column.isNotNull() & ~column.isin(*vocabulary)

    def strangers(names: Column, allowed: tuple[str, ...]) -> Column:
        return F.exists(names, lambda k: ~k.isin(*allowed))

    fault = F.when(F.trim(_text(task["task_name"])) == "", "task_name cannot be empty").when(
        F.trim(_text(task["problem_statement"])) == "", "problem_statement cannot be empty"
    ).when(strangers(own, fixed.TASK_FIELDS), "unknown field")
    for name, allowed in fixed.TASK_INNER_FIELDS.items():
        fault = fault.when(strangers(F.map_keys(keys[name]), allowed), f"{name}: unknown field")
    return fault.when(
        outside(task["input_mode"]["data_type"], fixed.DATA_TYPES), "input_mode: data_type is not in its vocabulary"
    ).when(outside(task["output_mode"]["prediction_type"], fixed.PREDICTION_TYPES), "output_mode: prediction_type is not in its vocabulary")


def task_missing() -> Column:
    return (
        F.col("task_type").isNull() | ~F.col("task_type").isin(*fixed.TASK_TYPES)
        | F.col("stated_decision").isNull() | ~F.col("stated_decision").isin(*fixed.DECISIONS)
    )


def gate(tasks: DataFrame) -> DataFrame:
    """Add errors, warnings and can_model to parsed tasks."""
    task, inputs, outputs, checks = F.col("task_type"), F.col("input_mode"), F.col("output_mode"), F.col("evaluation")
    errors, warnings = fixed.GATE_ERRORS, fixed.GATE_WARNINGS
    supervised = task.isin(*fixed.SUPERVISED_TASKS)
    before, after = errors["target_column"].split("%s")

    def blank(column: Column) -> Column:
        return F.trim(_text(column)) == ""

    def unset(column: Column) -> Column:
        return _text(column) == ""

    def listed(rules: list[tuple[Column, Column | str]]) -> Column:
        return F.array_compact(F.array(*[
            F.when(broken, text if isinstance(text, Column) else F.lit(text)) for broken, text in rules
        ]))

    failed = listed([
        (~task.isin(*fixed.MODELING_TASKS), errors["task_type"]),
        (F.col("decision") != "accepted", errors["decision"]),
        (~F.col("should_model"), errors["should_model"]),
        (F.size("gaps.critical") > 0, errors["critical"]),
        (F.coalesce(inputs["data_type"], F.lit("unknown")) == "unknown", errors["data_type"]),
        (F.size(_list(inputs["required_inputs"])) == 0, errors["required_inputs"]),
        (supervised & unset(inputs["target_column"]), F.concat(F.lit(before), task, F.lit(after))),
        ((task == "forecasting") & unset(inputs["time_column"]), errors["time_column"]),
        (F.coalesce(outputs["prediction_type"], F.lit("unknown")) == "unknown", errors["prediction_type"]),
        (blank(outputs["target_description"]), errors["target_description"]),
        (blank(outputs["output_format"]), errors["output_format"]),
        (blank(checks["primary_metric"]), errors["primary_metric"]),
    ])
    noted = listed([
        (F.size("gaps.optional") > 0, warnings["optional"]),
        ((task == "forecasting") & unset(inputs["data_granularity"]), warnings["granularity"]),
        ((task == "clustering") & ~unset(inputs["target_column"]), warnings["cluster_target"]),
        (blank(checks["validation_strategy"]), warnings["validation"]),
    ])
    return tasks.withColumns({"errors": failed, "warnings": noted}).withColumn(
        "can_model", (F.size("errors") == 0) & (F.size("warnings") == 0) & F.col("problem").isNull()
    )


def normalise(gated: DataFrame) -> DataFrame:
    """Accepted tasks with errors become need_info, those with only warnings need_confirmation. Inconsistent documents
    stay as they are, with their problem."""
    downgrade = (F.col("decision") == "accepted") & F.col("problem").isNull() & ((F.size("errors") > 0) | (F.size("warnings") > 0))
    to_info = downgrade & (F.size("errors") > 0)
    to_confirm = downgrade & ~to_info
    critical = F.when(to_info, F.array_distinct(F.concat("gaps.critical", "errors"))).otherwise(F.col("gaps.critical"))
    optional = F.when(to_confirm, F.array_distinct(F.concat("gaps.optional", "warnings"))).otherwise(F.col("gaps.optional"))

    def numbered(intro: str, items: Column) -> Column:
        lines = F.transform(items, lambda text, i: F.concat((i + 1).cast("string"), F.lit(". "), text))
        return F.concat(F.lit(intro), F.array_join(lines, "\n"))

    response = (
        F.when(to_info, numbered(fixed.GATE_NEED_INFO_INTRO, F.col("errors")))
        .when(to_confirm, numbered(fixed.GATE_CONFIRM_INTRO, optional)).otherwise(F.col("response"))
    )
    return gated.withColumns({
        "decision": F.when(to_info, "need_info").when(to_confirm, "need_confirmation").otherwise(F.col("decision")),
        "should_model": F.col("should_model") & ~downgrade,
        "gaps": F.struct(critical.alias("critical"), optional.alias("optional")),
        "response": response,
    })


def confirm(tasks: DataFrame) -> DataFrame:
    """Tasks that only wait for confirmation become accepted; the gaps turn into an assumption."""
    waiting = tasks.where((F.col("decision") == "need_confirmation") & (F.size("gaps.critical") == 0))
    note = F.concat(F.lit(fixed.CONFIRMED_ASSUMPTION), F.array_join("gaps.optional", fixed.CONFIRMED_JOINER))
    none = F.array().cast("array<string>")
    return waiting.withColumns({
        "decision": F.lit("accepted"), "should_model": F.lit(True),
        "assumptions": F.when(F.size("gaps.optional") > 0, F.concat("assumptions", F.array(note))).otherwise(F.col("assumptions")),
        "gaps": F.struct(none.alias("critical"), none.alias("optional")),
        "response": F.lit(fixed.CONFIRMED_RESPONSE),
    })


def decision_counts(tasks: DataFrame) -> DataFrame:
    """(task_type, decision, tasks) with subtotals; a null stands for all."""
    return tasks.rollup("task_type", "decision").agg(F.count(F.lit(1)).alias("tasks"))

"""Checking plan documents: each against the rules, and a plan against the columns it talks about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed

# The fields of a plan document and of its parts.
GROUPS = {
    # group: (field that names the method, its vocabulary, all fields)
    "missing_value_plan": ("strategy", fixed.MISSING_STRATEGIES, ("columns", "strategy", "fill_value", "reason")),
    "categorical_encoding_plan": ("encoding", fixed.ENCODINGS, ("columns", "encoding", "handle_unknown", "reason", "params")),
    "numeric_scaling_plan": ("scaling", fixed.SCALINGS, ("columns", "scaling", "reason", "params")),
    "text_processing_plan": ("method", fixed.TEXT_METHODS, ("columns", "method", "reason", "params")),
    "datetime_processing_plan": ("method", fixed.DATETIME_METHODS, ("columns", "method", "reason", "params")),
    "column_actions": ("action", None, ("columns", "action", "reason", "params")),
}
ARTIFACT_FIELDS = ("artifact_type", "path", "description", "required")
SPLIT_FIELDS = (
    "strategy", "train_size", "validation_size", "test_size", "random_state", "stratify_column", "time_column", "reason",
)
TEXT_FIELDS = ("plan_name", "status", "task_type", "target_column", "time_column", "user_facing_response", "downstream_notes")
LIST_FIELDS = (
    "input_files", "id_columns", "feature_columns", "drop_columns", "quality_issues_to_handle", "assumptions", "warnings",
)
PLAN_FIELDS = (*TEXT_FIELDS, *LIST_FIELDS, *GROUPS, "split_strategy", "output_artifacts")


def _struct(fields) -> str:
    kinds = {"columns": "array<string>"}
    return "struct<" + ",".join(f"{f}:{kinds.get(f, 'string')}" for f in fields) + ">"


PLAN_SCHEMA = ", ".join(
    [f"{f} string" for f in TEXT_FIELDS] + [f"{f} array<string>" for f in LIST_FIELDS]
    + [f"{g} array<{_struct(fields)}>" for g, (_, _, fields) in GROUPS.items()]
    + [f"split_strategy {_struct(SPLIT_FIELDS)}", f"output_artifacts array<{_struct(ARTIFACT_FIELDS)}>"]
)
# the part of it that rules read
NAMED_LISTS = ("input_files", "id_columns", "feature_columns", "drop_columns")
RULE_SCHEMA = ", ".join(
    [f"{f} string" for f in TEXT_FIELDS if f != "downstream_notes"] + [f"{f} array<string>" for f in NAMED_LISTS]
    + [f"{g} array<{_struct(('columns', method, *(['fill_value'] if 'fill_value' in fields else [])))}>" for g, (method, _, fields) in GROUPS.items()]
    + [f"split_strategy {_struct([f for f in SPLIT_FIELDS if f not in ('random_state', 'reason')])}"]
    + [f"output_artifacts array<{_struct(('artifact_type', 'path'))}>"]
)
# What kind of value each field takes where a vocabulary does not say so already. "?" may be null.
KINDS = {
    **{f: "text" for f in ("plan_name", "user_facing_response")}, **{f: "text?" for f in ("target_column", "time_column")},
    **{f: "texts" for f in LIST_FIELDS}, **{g: "objects" for g in (*GROUPS, "output_artifacts")}, "split_strategy": "object", "downstream_notes": "object",
}
PART_KINDS = {
    **{g: {"columns": "elements", "reason": "text"} | ({"params": "object"} if "params" in fields else {}) for g, (_, _, fields) in GROUPS.items()},
    "output_artifacts": {"path": "text", "description": "text", "required": "flag"},
}
PART_KINDS["categorical_encoding_plan"] |= {"handle_unknown": "text"}
PART_KINDS["column_actions"] |= {"action": "text"}
SPLIT_KINDS = {
    "train_size": "number?", "validation_size": "number?", "test_size": "number?", "random_state": "whole number?",
    "stratify_column": "text?", "time_column": "text?", "reason": "text",
}
KIND_TEXTS = {
    "text": "a text", "texts": "a list of texts", "elements": "a list of texts", "objects": "a list of objects", "object": "an object", "number": "a number",
    "whole number": "a whole number", "flag": "true or false",
}
FLAG_TEXTS = ("true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0")

# the same parts as maps, whose keys show fields that do not belong
KEYS_SCHEMA = ", ".join(
    [f"{g} array<map<string,string>>" for g in (*GROUPS, "output_artifacts")] + ["split_strategy map<string,string>"]
)
# the elements of a document's lists and parts
ITEMS = "struct<" + ",".join(
    [f"{f}:array<variant>" for f in LIST_FIELDS] + [f"{g}:array<map<string,variant>>" for g in PART_KINDS] + ["split_strategy:map<string,variant>"]
) + ">"


def parse_plans(df: DataFrame, document: str) -> DataFrame:
    """Add the struct `plan`; its fields are null where the text is not a JSON object."""
    return df.withColumn("plan", F.from_json(F.col(document), PLAN_SCHEMA))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _any(items: Column, bad) -> Column:
    return F.coalesce(F.exists(items, bad), F.lit(False))


def _strangers(keys: Column, allowed) -> Column:
    return F.exists(keys, lambda k: ~k.isin(*allowed))


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _misfit(value: Column, wanted: str, items: Column | None = None) -> Column:
    """Whether a value that is there is not of its kind. As readers of such documents do, numbers and flags may be given
    as texts that say them; a whole number may have a fraction of 0. `items` are the elements of a list, null for others."""
    kind, form = wanted.removesuffix("?"), F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    numeric, said = form.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), form == "STRING"
    fits = {
        "text": said, "object": form.startswith("OBJECT"), "number": numeric | (said & text.try_cast("double").isNotNull()),
        "whole number": (numeric & (number == F.floor(number))) | (said & text.rlike(r"^\s*[+-]?[0-9]+\s*$")),
        "flag": (form == "BOOLEAN") | (numeric & number.isin(0.0, 1.0)) | (said & F.lower(text).isin(*FLAG_TEXTS)),
        "texts": items.isNotNull() & ~_any(items, _no_text) if items is not None else None,
        "elements": ~_any(_elements(value), _no_text),
        "objects": items.isNotNull() & ~_any(items, lambda e: e.isNull()) if items is not None else None,
    }[kind]
    bad = value.isNotNull() & ~F.coalesce(fits, F.lit(False))
    return bad & (form != "VOID") if wanted.endswith("?") else bad


def _no_text(value: Column) -> Column:
    return F.schema_of_variant(value) != "STRING"


def _bad_part(name: str, kind: str) -> Callable[[Column], Column]:
    return lambda item: _misfit(item[name], kind)


def _kind_rules(fields: Column, items: Column) -> list[tuple[Column, str]]:
    """Values of the wrong kind, in the document and its parts."""
    rules = [
        (_misfit(fields[f], kind, items[f] if kind in ("texts", "objects") else None), f"{f} is not {KIND_TEXTS[kind.removesuffix('?')]}")
        for f, kind in KINDS.items()
    ]
    for group, kinds in PART_KINDS.items():
        for f, kind in kinds.items():
            rules.append((_any(items[group], _bad_part(f, kind)), f"{group}: {f} is not {KIND_TEXTS[kind]}"))
    split = items["split_strategy"]
    return rules + [(_misfit(split[f], kind), f"split_strategy: {f} is not {KIND_TEXTS[kind.removesuffix('?')]}") for f, kind in SPLIT_KINDS.items()]


def _opened(df: DataFrame, document: str) -> DataFrame:
    """Add the struct `plan`, the document's keys, its fields and items as variants, and whether it is regular.

    A document is parsed once, to a variant from which all this is read. Only one that is no JSON object, or whose parts
    are not what they should be, is parsed by the schemas as well (`__parts`), which say what becomes of misplaced values.
    """
    whole, fields, items, regular = (F.col(f"__{c}") for c in ("whole", "fields", "items", "regular"))
    opened = df.withColumn("__whole", F.try_parse_json(document)).withColumns({
        "__fields": F.try_variant_get(whole, "$", "map<string,variant>"), "__items": F.try_variant_get(whole, "$", ITEMS),
    })
    sound = fields.isNotNull() & (fields["split_strategy"].isNull() | items["split_strategy"].isNotNull())
    for group in GROUPS:
        listed = F.forall(items[group], lambda i: i.isNotNull() & (i["columns"].isNull() | _elements(i["columns"]).isNotNull()))
        sound &= F.coalesce(listed, fields[group].isNull())
    sound &= F.coalesce(F.forall(items["output_artifacts"], lambda i: i.isNotNull()), fields["output_artifacts"].isNull())
    return opened.withColumn("__regular", F.coalesce(sound, F.lit(False))).withColumns({
        "plan": F.when(regular, F.try_variant_get(whole, "$", f"struct<{RULE_SCHEMA}>")).otherwise(F.from_json(F.col(document), RULE_SCHEMA)),
        "__parts": F.when(~regular, F.from_json(F.col(document), KEYS_SCHEMA)),
        "__keys": F.when(regular, F.map_keys(fields)).otherwise(F.json_object_keys(document)),
    })


def _odd_fields(group: str, allowed) -> Column:
    """Whether a part of the document has a field that does not belong."""
    def odd(items: Column) -> Column:
        return _strangers(F.map_keys(items), allowed) if group == "split_strategy" else _any(items, lambda i: _strangers(F.map_keys(i), allowed))
    return F.when(F.col("__regular"), odd(F.col("__items")[group])).otherwise(odd(F.col("__parts")[group]))


def plan_errors(df: DataFrame, document: str) -> DataFrame:
    """Add `errors`, the rules a plan document breaks; a valid plan breaks none."""
    parsed = _opened(df, document)
    plan, texts = F.col("plan"), fixed.PLAN_ERRORS
    rules: list[tuple[Column, Column | str]] = [
        (_strangers(F.col("__keys"), PLAN_FIELDS), "unknown field"),
        (_blank(plan["plan_name"]), texts["plan_name"]),
        (~F.coalesce(plan["status"].isin(*fixed.PLAN_STATUSES), F.lit(False)), "status is not in its vocabulary"),
        (~F.coalesce(plan["task_type"].isin(*fixed.TASK_TYPES), F.lit(False)), "task_type is not in its vocabulary"),
    ]
    for name in NAMED_LISTS:
        rules.append((_any(plan[name], _blank), f"{name}: {texts['list_item']}"))
    for group, (method, vocabulary, fields) in GROUPS.items():
        rules += _group_rules(plan[group], group, method, vocabulary, fields)
    unfilled = lambda i: (i["strategy"] == "constant") & i["fill_value"].isNull()
    rules.append((_any(plan["missing_value_plan"], unfilled), texts["fill_value"]))
    rules += _split_rules(plan["split_strategy"])
    artifacts = plan["output_artifacts"]
    rules += [
        (_odd_fields("output_artifacts", ARTIFACT_FIELDS), "output_artifacts: unknown field"),
        (_any(artifacts, lambda a: ~F.coalesce(a["artifact_type"].isin(*fixed.ARTIFACT_TYPES), F.lit(False))),
         "output_artifacts: artifact_type is not in its vocabulary"),
        (_any(artifacts, lambda a: _blank(a["path"])), f"output_artifacts: {texts['path']}"),
    ]
    rules += _status_rules(plan)
    rules += _kind_rules(F.col("__fields"), F.col("__items"))
    # without nulls and repeats; array_compact would have all rules interpreted instead of compiled
    checked = F.array_except(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), text if isinstance(text, Column) else F.lit(text)) for broken, text in rules
    ]), F.array(F.lit(None).cast("string")))
    unreadable = plan.isNull() | F.col("__keys").isNull()
    return parsed.withColumn("errors", F.when(unreadable, F.array(F.lit("not a JSON object"))).otherwise(checked)).drop(
        "plan", "__parts", "__keys", "__whole", "__fields", "__items", "__regular"
    )


def _group_rules(items: Column, group: str, method: str, vocabulary, fields) -> list[tuple[Column, str]]:
    texts = fixed.PLAN_ERRORS
    rules = [
        (_odd_fields(group, fields), f"{group}: unknown field"),
        (_any(items, lambda i: F.coalesce(F.size(i["columns"]), F.lit(0)) < 1), f"{group}: {texts['columns']}"),
        (_any(items, lambda i: F.exists(i["columns"], _blank)), f"{group}: {texts['columns']}"),
    ]
    if vocabulary is None:
        return [*rules, (_any(items, lambda i: _blank(i[method])), f"{group}: {texts['action']}")]
    outside = _any(items, lambda i: ~F.coalesce(i[method].isin(*vocabulary), F.lit(False)))
    return [*rules, (outside, f"{group}: {method} is not in its vocabulary")]


def _split_rules(split: Column) -> list[tuple[Column, str]]:
    texts = fixed.PLAN_ERRORS
    sizes = F.array_compact(F.array(*[split[s].try_cast("double") for s in ("train_size", "validation_size", "test_size")]))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)
    outside = F.exists(sizes, lambda v: (v <= 0) | (v >= 1))
    given = split.isNotNull()
    return [
        (given & _odd_fields("split_strategy", SPLIT_FIELDS), "split_strategy: unknown field"),
        (given & ~F.coalesce(split["strategy"].isin(*fixed.SPLIT_STRATEGIES), F.lit(False)),
         "split_strategy: strategy is not in its vocabulary"),
        (outside, texts["size_range"]),
        (~outside & (total > 1.0), texts["size_sum"]),
        ((split["strategy"] == "stratified") & (F.coalesce(split["stratify_column"], F.lit("")) == ""), texts["stratify"]),
        ((split["strategy"] == "time_based") & (F.coalesce(split["time_column"], F.lit("")) == ""), texts["time_split"]),
    ]


def _status_rules(plan: Column) -> list[tuple[Column, Column | str]]:
    texts = fixed.PLAN_ERRORS
    runs = plan["status"] == "executable"
    before, after = texts["target_column"].split("%s")

    def empty(name: str) -> Column:
        return F.coalesce(F.size(plan[name]), F.lit(0)) < 1

    def unset(name: str) -> Column:
        return F.coalesce(plan[name], F.lit("")) == ""

    return [
        (runs & empty("input_files"), texts["input_files"]),
        (runs & plan["task_type"].isin(*fixed.SUPERVISED_TASKS) & unset("target_column"),
         F.concat(F.lit(before), plan["task_type"], F.lit(after))),
        (runs & (plan["task_type"] == "forecasting") & unset("time_column"), texts["time_column"]),
        (runs & empty("feature_columns"), texts["feature_columns"]),
        (runs & empty("output_artifacts"), texts["output_artifacts"]),
        ((plan["status"] == "need_info") & _blank(plan["user_facing_response"]), texts["need_info"]),
        ((plan["status"] == "rejected") & _blank(plan["user_facing_response"]), texts["rejected"]),
    ]


def plan_columns(df: DataFrame, document: str, key: str) -> DataFrame:
    """(key, place, name): every column a plan document mentions, and where; one pass over the documents."""
    plan = F.col("plan")
    lists = {n: plan[n] for n in ("id_columns", "feature_columns", "drop_columns")}
    lists |= {n: F.array_compact(F.array(plan[n])) for n in ("target_column", "time_column")}
    lists |= {g: F.flatten(F.transform(plan[g], lambda i: i["columns"])) for g in GROUPS}
    split = plan["split_strategy"]
    lists["split_strategy"] = F.array_compact(F.array(split["stratify_column"], split["time_column"]))
    places = F.array(*[F.struct(F.lit(p).alias("place"), n.alias("names")) for p, n in lists.items()])
    unfolded = parse_plans(df, document).select(key, F.inline(places))
    return unfolded.select(key, "place", F.explode("names").alias("name"))


def plan_conflicts(df: DataFrame, document: str, key: str, columns: DataFrame) -> DataFrame:
    """(key, problem, place, name): unknown columns, and targets or ids among the features.

    `columns` has a `name` per real column of the table (a column profile will do).
    """
    mentioned = plan_columns(df, document, key)
    real = F.broadcast(columns.select("name", F.lit(True).alias("known")).distinct())
    place = F.col("place")
    marked = mentioned.join(real, "name", "left")
    unknown = marked.where(F.col("known").isNull()).select(key, F.lit("unknown_column").alias("problem"), "place", "name")
    per_name = mentioned.where(place.isin("feature_columns", "target_column", "id_columns")).groupBy(key, "name").agg(
        F.bool_or(place == "feature_columns").alias("feature"), F.bool_or(place == "target_column").alias("target"),
        F.bool_or(place == "id_columns").alias("id"),
    )
    leaks = F.array_compact(F.array(
        F.when(F.col("target"), F.struct(F.lit("target_in_features").alias("problem"), F.lit("target_column").alias("place"))),
        F.when(F.col("id"), F.struct(F.lit("id_in_features").alias("problem"), F.lit("id_columns").alias("place"))),
    ))
    leaking = per_name.where("feature").select(key, F.inline(leaks), "name")
    return unknown.unionByName(leaking)

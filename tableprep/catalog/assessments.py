"""Registered queries: roles, quality rules, default plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.catalog.common import (
    EVENTS_GAPS,
    LABELLED,
    LABELLED_COLUMNS,
    TABLES,
    labelled_documents,
    profile_sql,
    read,
)
from tableprep.operators import profile, quality, remedies, roles
from tableprep.plans import assess, defaults

# name -> (SQL source, columns, task type, target, time, Spark source)
CASES = {
    "customer": ("customer", TABLES["customer"], "classification", "c_mktsegment", None),
    "lineitem": ("lineitem", TABLES["lineitem"], "regression", "l_extendedprice", None),
    "orders": ("orders", TABLES["orders"], "classification", None, None),
    "events": ("events", TABLES["events"], "forecasting", "value", "ts"),
    "part": ("part", TABLES["part"], "clustering", "p_brand", None),
    "nation": ("nation", TABLES["nation"], "regression", "n_population", None),
    "labelled": (f"({LABELLED})", LABELLED_COLUMNS, "classification", "quality", None),
    "gaps": (
        f"(SELECT event_id, ts, user_id, event_type, {EVENTS_GAPS} AS value, CASE WHEN value > 20 THEN value END AS large, "
        "'same' AS fixed, CASE WHEN value < 0 THEN value END AS nothing FROM events)",
        [*TABLES["events"][:4], ("value", "float"), ("large", "float"), ("fixed", "string"), ("nothing", "float")],
        "forecasting", "value", None,
    ),
}

# Tables in which rules fire that the tables as they are give no cause for: name -> (table, expressions, condition).
_CUSTOMER = ["c_custkey", "c_acctbal"]
MADE = {
    "single_class": ("customer", [*_CUSTOMER, "'one' AS label"], "true"),
    "imbalanced": ("customer", [*_CUSTOMER, "CASE WHEN c_custkey % 50 = 0 THEN 'rare' ELSE 'usual' END AS label"], "true"),
    "copied": ("orders", ["o_orderstatus", "o_orderpriority", "o_orderstatus AS label"], "true"),
    "empty": ("customer", [*_CUSTOMER, "c_mktsegment AS label"], "c_custkey < 0"),
    "timeless": ("customer", ["c_acctbal", "c_mktsegment"], "true"),
    "unparsed": ("customer", ["concat('week ', c_nationkey) AS date", "c_acctbal", "c_mktsegment"], "true"),
}
_LABEL = [("c_custkey", "integer"), ("c_acctbal", "float"), ("label", "string")]
_KINDS = {
    "single_class": (_LABEL, "classification", "label", None), "imbalanced": (_LABEL, "classification", "label", None),
    "copied": ([("o_orderstatus", "string"), ("o_orderpriority", "string"), ("label", "string")], "classification", "label", None),
    "empty": (_LABEL, "classification", "label", None),
    "timeless": ([("c_acctbal", "float"), ("c_mktsegment", "string")], "forecasting", "c_acctbal", None),
    "unparsed": ([("date", "string"), ("c_acctbal", "float"), ("c_mktsegment", "string")], "forecasting", "c_acctbal", "date"),
}
CASES |= {c: (f"(SELECT {', '.join(MADE[c][1])} FROM {MADE[c][0]} WHERE {MADE[c][2]})", *_KINDS[c]) for c in MADE}


def source(spark: SparkSession, sf_dir: str, case: str) -> DataFrame:
    if case in MADE:
        table, expressions, condition = MADE[case]
        return read(spark, sf_dir, table).where(condition).selectExpr(*expressions)
    if case == "labelled":
        return labelled_documents(spark, sf_dir).select([c for c, _ in LABELLED_COLUMNS])
    if case == "gaps":
        return read(spark, sf_dir, "events").selectExpr(
            "event_id", "ts", "user_id", "event_type", f"{EVENTS_GAPS} AS value", "CASE WHEN value > 20 THEN value END AS large",
            "'same' AS fixed", "CASE WHEN value < 0 THEN value END AS nothing",
        )
    return read(spark, sf_dir, case)


def task(case: str) -> roles.Task:
    return roles.Task(*CASES[case][2:5])


def assessed(spark, sf_dir, case) -> assess.Assessment:
    return assess.assess(source(spark, sf_dir, case), case, task(case))


def _roles(case):
    def run(s, d):
        columns = profile.column_profile(source(s, d, case), case, include_value_counts=False, median="none")
        return roles.column_roles(columns, task(case)).select(
            "dataset_name", "name", "semantic_type", "role", "recommended_use", "confidence",
            F.array_join("reasons", "; ").alias("reasons"),
        )
    return run


def _rollup(case):
    def run(s, d):
        a = assessed(s, d, case)
        lists = ("feature_columns", "target_candidates", "id_columns", "time_columns", "drop_columns", "warnings")
        return a.rollup.select("dataset_name", "task_type", "target_column", *[F.array_join(c, "|").alias(c) for c in lists])
    return run


def _issues(case):
    def run(s, d):
        return assessed(s, d, case).issues.select(
            "dataset_name", "issue_type", "severity", F.array_join("columns", ",").alias("columns"), "message",
            "recommendation", "blocking",
        )
    return run


def _summary(case):
    def run(s, d):
        return assessed(s, d, case).summary.withColumn("recommended_actions", F.array_join("recommended_actions", "|"))
    return run


def catalog_issues(s, d):
    tables = {t: read(s, d, t) for t in TABLES}
    a = assess.assess_catalog(tables, {t: task(t) for t in ("customer", "lineitem", "orders", "nation")})
    return a.issues.select("dataset_name", "issue_type", F.array_join("columns", ",").alias("columns"), "blocking")


def _column_plan(case):
    def run(s, d):
        a = assessed(s, d, case)
        return defaults.column_plan(a.columns, a.roles).drop("position")
    return run


def _plan_header(case):
    def run(s, d):
        a = assessed(s, d, case)
        return defaults.plan_header(a.rollup, a.summary).drop("recommended_actions")
    return run


def fix_drop_flagged(s, d):
    """Ids, constant and all-missing columns go, as the issues and roles say."""
    df = source(s, d, "gaps")
    a = assessed(s, d, "gaps")
    kept = remedies.drop_all_missing(remedies.drop_constant(remedies.drop_identifiers(df, a.roles), a.issues), a.issues)
    return kept.groupBy("event_type").agg(
        F.lit(",".join(kept.columns)).alias("columns"), F.count("value").alias("known"), F.round(F.sum("large"), 3).alias("large")
    )


def _text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def roles_sql(case: str) -> str:
    src, columns, task_type, target, time = CASES[case]
    supervised = str(task_type in fixed.SUPERVISED_TASKS).lower()
    forecasting = str(task_type == "forecasting").lower()
    pairs = " OR ".join(
        f"len(list_filter(sample_values, lambda v: lower(trim(v)) NOT IN ('{a}', '{b}'))) = 0" for a, b in fixed.BINARY_PAIRS
    )
    spaced = "len(list_filter(sample_values, lambda v: contains(trim(v), ' ')))"
    total = "list_sum(list_transform(sample_values, lambda v: length(v)))"
    missing = (
        f"CASE WHEN missing_rate > 0 THEN '; {fixed.REASON_MISSING}' || missing_rate::VARCHAR ELSE '' END"
    )
    typed = f"'{fixed.REASON_TYPE}' || type_class"
    return f"""
    SELECT dataset_name, position, name,
      CASE rule WHEN 'time' THEN 'datetime' WHEN 'datetime' THEN 'datetime' WHEN 'id' THEN 'id' ELSE meaning END AS semantic_type,
      CASE rule WHEN 'target' THEN 'target' WHEN 'time' THEN 'time_index'
        WHEN 'datetime' THEN CASE WHEN {forecasting} THEN 'time_index' ELSE 'feature' END
        WHEN 'id' THEN 'identifier' WHEN 'candidate' THEN 'target_candidate' ELSE 'feature' END AS role,
      CASE rule WHEN 'target' THEN 'target' WHEN 'time' THEN 'time_index'
        WHEN 'datetime' THEN CASE WHEN {forecasting} THEN 'time_index' ELSE 'use' END
        WHEN 'id' THEN 'drop' WHEN 'candidate' THEN 'review'
        ELSE CASE meaning WHEN 'text' THEN 'use_text' WHEN 'high_cardinality_categorical' THEN 'review' ELSE 'use' END END AS recommended_use,
      CASE rule WHEN 'target' THEN 1.0::DOUBLE WHEN 'time' THEN 1.0::DOUBLE WHEN 'datetime' THEN 0.9::DOUBLE WHEN 'id' THEN 0.9::DOUBLE
        WHEN 'candidate' THEN 0.65::DOUBLE
        ELSE CASE meaning WHEN 'text' THEN 0.7::DOUBLE WHEN 'high_cardinality_categorical' THEN 0.65::DOUBLE ELSE 0.8::DOUBLE END END AS confidence,
      CASE rule WHEN 'target' THEN '{fixed.REASON_EXPLICIT_TARGET}' WHEN 'time' THEN '{fixed.REASON_EXPLICIT_TIME}'
        WHEN 'datetime' THEN '{fixed.REASON_DATETIME}' WHEN 'id' THEN '{fixed.REASON_ID}'
        WHEN 'candidate' THEN {typed} || '; {fixed.REASON_CANDIDATE}'
        ELSE {typed} || CASE meaning WHEN 'text' THEN '; {fixed.REASON_TEXT}'
          WHEN 'high_cardinality_categorical' THEN '; {fixed.REASON_HIGH_CARDINALITY}' ELSE '' END END || {missing} AS reasons,
      row_count, non_null_count, missing_count, missing_rate, unique_count, has_datetime_summary, type_class
    FROM (SELECT *,
      CASE WHEN lower(name) = lower(trim({_text(target)})) THEN 'target' WHEN lower(name) = lower(trim({_text(time)})) THEN 'time'
        WHEN has_datetime_summary THEN 'datetime'
        WHEN regexp_matches(lower(name), '{fixed.ID_NAME_PATTERN}')
          OR (type_class IN ('string', 'object') AND row_count >= 10 AND unique_count = row_count AND unique_rate >= 0.8) THEN 'id'
        WHEN {supervised} AND regexp_matches(lower(name), '{fixed.TARGET_NAME_PATTERN}') THEN 'candidate' ELSE 'feature' END AS rule,
      CASE WHEN has_datetime_summary THEN 'datetime'
        WHEN type_class IN ('integer', 'float') AND len(sample_values) > 0 AND ({pairs}) THEN 'boolean'
        WHEN type_class IN ('integer', 'float') THEN 'numeric'
        WHEN type_class = 'string' AND len(sample_values) > 0
          AND ({total} >= 40 * len(sample_values) OR {spaced} >= greatest(1, len(sample_values) // 2)) THEN 'text'
        WHEN unique_count > 20 THEN 'high_cardinality_categorical' ELSE 'categorical' END AS meaning
      FROM ({profile_sql(src, case, columns)}))"""


def rollup_sql(case: str) -> str:
    _, _, task_type, target, time = CASES[case]

    def names(condition: str) -> str:
        return f"coalesce(string_agg(name, '|' ORDER BY position) FILTER ({condition}), '')"

    candidates = "count(*) FILTER (role = 'target_candidate')"
    targets, times = "count(*) FILTER (role = 'target')", "count(*) FILTER (role = 'time_index')"
    warnings = []
    if target:
        warnings.append(f"CASE WHEN {targets} = 0 THEN '{fixed.WARN_TARGET_ABSENT}{target}' END")
    if time:
        warnings.append(f"CASE WHEN count(*) FILTER (lower(name) = '{time}') = 0 THEN '{fixed.WARN_TIME_ABSENT}{time}' END")
    if task_type in ("classification", "regression"):
        warnings.append(f"CASE WHEN {targets} = 0 AND {candidates} > 0 THEN '{fixed.WARN_REVIEW_CANDIDATES}' WHEN {targets} = 0 THEN '{fixed.WARN_NO_TARGET}' END")
    if task_type == "forecasting":
        warnings.append(f"CASE WHEN {times} = 0 THEN '{fixed.WARN_NO_TIME}' END")
    if task_type == "clustering":
        warnings.append(f"CASE WHEN {targets} > 0 THEN '{fixed.WARN_CLUSTER_TARGET}' END")
    return f"""
    SELECT dataset_name, '{task_type}' AS task_type, min(name) FILTER (role = 'target') AS target_column,
      {names("role = 'feature'")} AS feature_columns, {names("role = 'target_candidate'")} AS target_candidates,
      {names("role = 'identifier'")} AS id_columns, {names("role = 'time_index'")} AS time_columns,
      {names("recommended_use = 'drop'")} AS drop_columns, concat_ws('|', {', '.join(warnings)}) AS warnings
    FROM ({roles_sql(case)}) GROUP BY dataset_name"""


def issues_sql(case: str) -> str:
    src, columns, task_type, target, time = CASES[case]
    texts = fixed.ISSUE_TEXTS
    parts: list[str] = []

    def rule(kind: str, severity: str, source_sql: str, where: str, subject: str | None = None, column: bool = True, at: str = "0") -> None:
        message, advice = texts[kind]
        said = "'" + message.replace("%s", f"' || {subject} || '") + "'" if subject else f"'{message}'"
        named = subject if subject and column else "''"
        parts.append(
            f"SELECT '{case}' AS dataset_name, '{kind}' AS issue_type, '{severity}' AS severity, {named} AS columns, {said} AS message, "
            f"'{advice}' AS recommendation, {str(severity == 'error').lower()} AS blocking, {len(parts)} AS rule_order, {at} AS position "
            f"FROM {source_sql} WHERE {where}"
        )

    whole = f"(SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS copies FROM {src})"
    rule("empty_dataset", "error", whole, "n = 0")
    rule("too_few_rows", "warning", whole, "n > 0 AND n < 50", "n", False)
    rule("duplicate_rows", "warning", whole, "copies > 0", "copies", False)
    rule("all_missing_column", "error", "r", "non_null_count = 0", "name", at="position")
    rule("high_missing_rate", "warning", "r", "non_null_count > 0 AND missing_rate >= 0.4", "name", at="position")
    rule("constant_column", "warning", "r", "non_null_count > 0 AND unique_count <= 1 AND role <> 'target'", "name", at="position")
    rule("no_feature_columns", "error", "(SELECT count(*) FILTER (role = 'feature') AS features FROM r)", "features = 0")
    if task_type in fixed.SUPERVISED_TASKS:
        if target is None:
            rule("target_missing", "error", "(SELECT 1)", "true")
        else:
            rule("target_not_found", "error", f"(SELECT '{target}' AS name)", "name NOT IN (SELECT name FROM r)", "name")
            rule("target_missing_values", "error", "r", f"name = '{target}' AND missing_rate > 0", "name")
            if task_type == "classification":
                rule("target_single_class", "error", "r", f"name = '{target}' AND unique_count < 2", "name")
                top = f"(SELECT max(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {src} WHERE {target} IS NOT NULL GROUP BY {target}))"
                rule("class_imbalance", "warning", "r", f"name = '{target}' AND unique_count >= 2 AND {top} >= 0.9", "name")
    if task_type == "forecasting":
        rule("time_index_missing", "error", "(SELECT count(*) FILTER (role = 'time_index') AS times FROM r)", "times = 0")
        rule("time_index_not_parseable", "warning", "r", "role = 'time_index' AND NOT has_datetime_summary", "name")
    rule("high_cardinality_categorical", "warning", "r", "semantic_type = 'high_cardinality_categorical'", "name", at="position")
    return f"WITH r AS ({roles_sql(case)}) " + " UNION ALL ".join(parts)


def summary_sql(case: str) -> str:
    order = "ORDER BY CASE issue_type WHEN 'high_missing_rate' THEN rule_order - 1 ELSE rule_order END, position"
    return f"""
    SELECT '{case}' AS dataset_name, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count,
      0 AS info_count, count(*) FILTER (blocking) AS blocking_issue_count, count(*) FILTER (blocking) = 0 AS can_continue,
      coalesce(CASE WHEN count(*) FILTER (blocking) > 0 THEN string_agg(recommendation, '|' {order}) FILTER (blocking)
        ELSE string_agg(recommendation, '|' {order}) FILTER (severity = 'warning') END, '') AS recommended_actions
    FROM ({issues_sql(case)})"""


def column_plan_sql(case: str) -> str:
    return f"""
    SELECT dataset_name, name, role, semantic_type, feature AND unique_count > 1 AS is_feature,
      recommended_use = 'drop' OR non_null_count = 0 OR (feature AND unique_count <= 1) AS is_dropped,
      CASE WHEN non_null_count = 0 THEN 'drop_column' WHEN role IN ('target', 'time_index') AND missing_count > 0 THEN 'drop_rows'
        WHEN feature AND missing_count > 0 AND semantic_type = 'numeric' THEN 'median'
        WHEN feature AND missing_count > 0 AND semantic_type IN ('categorical', 'boolean', 'high_cardinality_categorical') THEN 'mode'
        ELSE 'none' END AS missing_strategy,
      CASE WHEN feature AND semantic_type = 'categorical' THEN 'one_hot'
        WHEN feature AND semantic_type = 'high_cardinality_categorical' THEN 'frequency' ELSE 'none' END AS encoding,
      CASE WHEN feature AND semantic_type = 'numeric' THEN 'standard' ELSE 'none' END AS scaling,
      CASE WHEN feature AND semantic_type = 'text' THEN 'tfidf' ELSE 'none' END AS text_method,
      CASE WHEN role = 'time_index' AND non_null_count > 0 THEN 'sort_index'
        WHEN feature AND semantic_type = 'datetime' THEN 'extract_parts' ELSE 'none' END AS datetime_method
    FROM (SELECT *, role = 'feature' AND non_null_count > 0 AS feature FROM ({roles_sql(case)}))"""


def header_sql(case: str) -> str:
    task_type = CASES[case][2]
    split = {"classification": "stratified", "regression": "random", "forecasting": "time_based"}.get(task_type, "none")
    needs_target = "AND target_column IS NOT NULL" if task_type in fixed.SUPERVISED_TASKS else ""
    needs_time = "AND time_column IS NOT NULL" if task_type == "forecasting" else ""
    return f"""
    SELECT r.dataset_name, CASE WHEN blocking_issue_count = 0 AND feature_columns <> '' {needs_target} {needs_time}
        THEN 'executable' ELSE 'need_info' END AS status,
      '{task_type}' AS task_type, target_column, time_column, '{split}' AS split_strategy, blocking_issue_count
    FROM (SELECT *, nullif(split_part(time_columns, '|', 1), '') AS time_column FROM ({rollup_sql(case)})) r
    JOIN ({summary_sql(case)}) s ON r.dataset_name = s.dataset_name"""


ROLE_COLUMNS = "dataset_name, name, semantic_type, role, recommended_use, confidence, reasons"
ISSUE_COLUMNS = "dataset_name, issue_type, severity, columns, message, recommendation, blocking"


def _catalog_issues_sql() -> str:
    """Tables without a task have no target rules; the same rules otherwise."""
    parts = []
    for t in TABLES:
        known = CASES.get(t)
        given = known if t in ("customer", "lineitem", "orders", "nation") else (t, TABLES[t], None, None, None)
        kept, CASES[t] = CASES.get(t), given
        parts.append(f"SELECT dataset_name, issue_type, columns, blocking FROM ({issues_sql(t)})")
        if kept is None:
            del CASES[t]
        else:
            CASES[t] = kept
    return " UNION ALL ".join(parts)


def quality_id_leakage(s, d):
    """Roles edited by hand, with every column a feature: the identifiers among them leak."""
    df = read(s, d, "orders")
    columns = profile.column_profile(df, "orders")
    found = roles.column_roles(columns)
    rollup = roles.table_roles(found).withColumn("feature_columns", F.array(*[F.lit(c) for c in df.columns]))
    issues = quality.quality_issues(profile.table_profile(df, "orders"), columns, found, rollup).where(F.col("issue_type") == "possible_id_leakage")
    return issues.select("dataset_name", F.array_join("columns", ",").alias("name"), "severity", "message", "recommendation", "blocking", "evidence")


def _leakage_sql() -> str:
    message, recommendation = fixed.ISSUE_TEXTS["possible_id_leakage"]
    before, after = (t.replace("'", "''") for t in message.split("%s"))
    return (
        f"SELECT dataset_name, name, 'warning' AS severity, '{before}' || name || '{after}' AS message, '{recommendation.replace(chr(39), chr(39) * 2)}' AS recommendation, "
        f"false AS blocking, '{{\"semantic_type\":\"' || semantic_type || '\"}}' AS evidence FROM ({roles_sql('orders')}) WHERE role = 'identifier'"
    )


QUERIES = {
    "quality_id_leakage": (quality_id_leakage, _leakage_sql()),
    **{f"roles_{c}": (_roles(c), f"SELECT {ROLE_COLUMNS} FROM ({roles_sql(c)})") for c in ("customer", "lineitem", "events", "labelled", "part")},
    **{f"role_lists_{c}": (_rollup(c), rollup_sql(c)) for c in ("orders", "nation", "part", "gaps")},
    **{f"quality_{c}": (_issues(c), f"SELECT {ISSUE_COLUMNS} FROM ({issues_sql(c)})") for c in ("lineitem", "orders", "nation", "labelled", "gaps", *MADE)},
    **{f"quality_summary_{c}": (_summary(c), summary_sql(c)) for c in ("labelled", "gaps", "customer")},
    "fix_drop_flagged": (
        fix_drop_flagged,
        "SELECT event_type, 'ts,event_type,value,large' AS columns, count(value) AS known, round(sum(large), 3) AS large "
        f"FROM {CASES['gaps'][0]} GROUP BY event_type",
    ),
    "quality_catalog": (catalog_issues, _catalog_issues_sql()),
    **{f"plan_columns_{c}": (_column_plan(c), column_plan_sql(c)) for c in ("customer", "labelled", "gaps")},
    **{f"plan_header_{c}": (_plan_header(c), header_sql(c)) for c in ("customer", "lineitem", "events", "labelled")},
}

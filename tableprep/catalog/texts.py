"""Registered queries: response parsing, plan documents, the task gate.

Responses and documents are made from the rows of the test tables by expressions both engines
share, so each kind of document occurs about equally often and their number follows the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.catalog.common import read
from tableprep.operators import documents, taskgate
from tableprep.plans import checks
from tableprep.session import materialize

KIND = "(conv_id + turn) % 8"
NUMBER = "CAST(conv_id AS STRING)"
BREAK = "chr(10)"
RESPONSE = (
    f"CASE {KIND} "
    f"WHEN 0 THEN 'Measured:' || {BREAK} || '```json' || {BREAK} || '{{\"depth\": ' || {NUMBER} || '}}' || {BREAK} || '```' || {BREAK} || text "
    f"WHEN 1 THEN 'my guess {{\"hours\": [3, ' || {NUMBER} || '], \"sky\": \"clear}}\"}} so far. ' || text "
    f"WHEN 2 THEN '```sql' || {BREAK} || 'abs(' || {NUMBER} || ')' || {BREAK} || '```' || {BREAK} || '```JSON' || {BREAK} || '[' || {NUMBER} || ']' || {BREAK} || '```' "
    "WHEN 3 THEN text "
    f"WHEN 4 THEN text || '{{\"open\": [1, ' || {NUMBER} "
    "WHEN 5 THEN 'bad {not json} ' || text "
    f"WHEN 6 THEN '  ```' || {BREAK} || '[{{\"n\": ' || {NUMBER} || '}}]' || {BREAK} || '```  ' "
    f"ELSE '{{\"quote\": \"a \\\" {{ b\", \"n\": ' || {NUMBER} || '}} tail ]' END"
)
SPARK_RESPONSE = RESPONSE.replace('\\"', '\\\\"')  # Spark reads a backslash in a literal as an escape


def responses(s, d):
    return read(s, d, "conversations").selectExpr("conv_id", "turn", "role", f"{SPARK_RESPONSE} AS response")


RESPONSES = f"SELECT conv_id, turn, role, text, {KIND} AS kind, {RESPONSE} AS response FROM conversations"


def doc_fences(s, d):
    rows = responses(s, d)
    return rows.select(
        "conv_id", "turn",
        F.array_join(documents.fenced_blocks(F.col("response")), "|").alias("blocks"),
        F.array_join(documents.fenced_blocks(F.col("response"), "json"), "|").alias("json_blocks"),
    )


def doc_strip_fence(s, d):
    return responses(s, d).select("conv_id", "turn", documents.strip_fence(F.col("response")).alias("bare"))


def doc_json(s, d):
    return documents.extract_json(responses(s, d), "response").select("conv_id", "turn", "json_text", "json_status")


def doc_json_yield(s, d):
    return documents.json_yield(documents.extract_json(responses(s, d), "response"), ["role"]).withColumn("yield", F.round("yield", 6))


JSON_TEXT = (
    "CASE kind WHEN 0 THEN '{\"depth\": ' || conv_id || '}' WHEN 1 THEN '{\"hours\": [3, ' || conv_id || '], \"sky\": \"clear}\"}' "
    "WHEN 2 THEN '[' || conv_id || ']' WHEN 5 THEN '{not json}' WHEN 6 THEN '[{\"n\": ' || conv_id || '}]' "
    "WHEN 7 THEN '{\"quote\": \"a \\\" { b\", \"n\": ' || conv_id || '}' END"
)
JSON_STATUS = "CASE kind WHEN 3 THEN 'none' WHEN 4 THEN 'unbalanced' WHEN 5 THEN 'invalid' ELSE 'ok' END"


def orders(s, d, *columns):
    """Orders that documents are made of, dealt evenly: of rows this narrow millions fit one split of a file, whose task
    would make and read all their documents."""
    rows = read(s, d, "orders").select("o_orderkey", *columns)
    return rows.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


# ---- plan documents, one per order ----
PLAN_KIND = "o_orderkey % 12"


def _plan_text() -> str:
    def field(name: str, cases: dict[int, str], default: str) -> str:
        whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items())
        return f"'\"{name}\": ' || CASE {PLAN_KIND} {whens} ELSE '{default}' END"

    parts = [
        "'{\"plan_name\": \"plan ' || CAST(o_orderkey AS STRING) || '\"'",
        field("status", {6: '"need_info"', 7: '"rejected"', 8: '"maybe"'}, '"executable"'),
        field("task_type", {2: '"forecasting"'}, '"classification"'),
        field("input_files", {9: "[]"}, '["orders.parquet"]'),
        field("target_column", {1: "null"}, '"o_orderpriority"'),
        "'\"id_columns\": [\"o_orderkey\"]'",
        field("feature_columns", {10: '["o_totalprice", "o_orderpriority", "o_orderkey", "o_colour"]'}, '["o_totalprice", "o_orderstatus"]'),
        field("missing_value_plan", {3: '[{"columns": ["o_totalprice"], "strategy": "constant"}]'},
              '[{"columns": ["o_totalprice"], "strategy": "median", "reason": "numeric"}]'),
        field("categorical_encoding_plan", {11: '[{"columns": [], "encoding": "one_hot"}]'}, '[{"columns": ["o_orderstatus"], "encoding": "one_hot"}]'),
        field("split_strategy", {4: '{"strategy": "stratified", "train_size": 0.7}', 5: '{"strategy": "random", "train_size": 0.8, "test_size": 0.4}'},
              '{"strategy": "random", "train_size": 0.8, "test_size": 0.2}'),
        "'\"output_artifacts\": [{\"artifact_type\": \"train_data\", \"path\": \"out/train\"}]'",
        field("user_facing_response", {7: '"No."'}, '""'),
    ]
    return " || ', ' || ".join(parts) + f" || CASE {PLAN_KIND} WHEN 8 THEN ', \"surprise\": 1}}' ELSE '}}' END"


PLAN_TEXT = _plan_text()


def plan_documents(s, d):
    return orders(s, d).selectExpr("o_orderkey", f"{PLAN_TEXT} AS document")


def doc_plan_errors(s, d):
    checked = checks.plan_errors(plan_documents(s, d), "document")
    return checked.select("o_orderkey", F.size("errors").alias("error_count"), F.array_join("errors", "|").alias("errors"))


def _plan_errors_sql() -> str:
    texts = fixed.PLAN_ERRORS
    found = {
        1: texts["target_column"].replace("%s", "classification"), 2: texts["time_column"], 3: texts["fill_value"],
        4: texts["stratify"], 5: texts["size_sum"], 6: texts["need_info"],
        8: "unknown field|status is not in its vocabulary", 9: texts["input_files"],
        11: f"categorical_encoding_plan: {texts['columns']}",
    }
    counts = " ".join(f"WHEN {k} THEN {v.count('|') + 1}" for k, v in found.items())
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in found.items())
    return (
        f"SELECT o_orderkey, CASE {PLAN_KIND} {counts} ELSE 0 END AS error_count, CASE {PLAN_KIND} {names} ELSE '' END AS errors FROM orders"
    )


KIND_FAULTS = {
    # a value of the wrong kind, and what is said of it
    1: ("plan_name", "5", "plan_name is not a text"), 2: ("assumptions", '"not a list"', "assumptions is not a list of texts"),
    3: ("warnings", '["a", 1]', "warnings is not a list of texts"), 4: ("downstream_notes", "[]", "downstream_notes is not an object"),
    5: ("split_strategy", '{"strategy": "random", "train_size": "lots"}', "split_strategy: train_size is not a number"),
    6: ("split_strategy", '{"strategy": "random", "random_state": 1.5}', "split_strategy: random_state is not a whole number"),
    7: ("categorical_encoding_plan", '[{"columns": ["o_orderstatus"], "encoding": "one_hot", "handle_unknown": 5}]', "categorical_encoding_plan: handle_unknown is not a text"),
    8: ("missing_value_plan", '"fill"', "missing_value_plan is not a list of objects"),
    9: ("output_artifacts", '[{"artifact_type": "train_data", "path": "p", "required": "maybe"}]', "output_artifacts: required is not true or false"),
    10: ("split_strategy", '{"strategy": "random", "train_size": "0.7", "random_state": "7"}', ""),
    11: ("user_facing_response", "null", "user_facing_response is not a text"),
}


def doc_plan_kinds(s, d):
    """Documents with one value of the wrong kind each; the order's priority and number stand in them."""
    base = {
        "status": '"executable"', "task_type": '"classification"', "input_files": '["orders.parquet"]', "target_column": '"o_orderpriority"', "feature_columns": '["o_totalprice"]',
    }
    fields = {f for f, _, _ in KIND_FAULTS.values()}
    whole = {
        "plan_name": "'\"' || o_orderpriority || ' ' || CAST(o_orderkey AS STRING) || '\"'", "output_artifacts": "'[{\"artifact_type\": \"train_data\", \"path\": \"p\"}]'",
        "user_facing_response": "'\"\"'", "split_strategy": "'{\"strategy\": \"none\"}'", "downstream_notes": "'{}'",
    }
    parts = [f"'\"{f}\": {text}'" for f, text in base.items()]
    for f in sorted(fields):
        cases = " ".join(f"WHEN {k} THEN '{text}'" for k, (own, text, _) in KIND_FAULTS.items() if own == f)
        parts.append(f"'\"{f}\": ' || CASE {PLAN_KIND} {cases} ELSE {whole.get(f, chr(39) + '[]' + chr(39))} END")
    text = "'{' || " + " || ', ' || ".join(parts) + " || '}'"
    rows = orders(s, d, "o_orderpriority").selectExpr("o_orderkey", "o_orderpriority", f"{text} AS document")
    return checks.plan_errors(rows, "document").select("o_orderkey", "o_orderpriority", F.array_join("errors", "|").alias("errors"))


def doc_plan_conflicts(s, d):
    columns = s.createDataFrame([(c,) for c in read(s, d, "orders").columns], "name string")
    return checks.plan_conflicts(plan_documents(s, d), "document", "o_orderkey", columns)


# ---- task definitions, one per order ----
TASK_KIND = "o_orderkey % 11"


def _task_text() -> str:
    def pick(cases: dict[int, str], default: str) -> str:
        return f"CASE {TASK_KIND} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items()) + f" ELSE '{default}' END"

    return " || ".join([
        "'{\"task_name\": \"t' || CAST(o_orderkey AS STRING) || '\", \"problem_statement\": \"p\", \"task_type\": '",
        pick({2: '"forecasting"', 3: '"clustering"', 4: '"unknown"', 9: '"forecasting"'}, '"classification"'),
        "', \"decision\": '",
        pick({5: '"need_info"', 6: '"need_confirmation"'}, '"accepted"'),
        "', \"should_model\": true, \"input_mode\": {\"data_type\": '",
        pick({7: '"unknown"'}, '"tabular"'),
        "', \"required_inputs\": '",
        pick({7: "[]"}, '["rows"]'),
        "', \"target_column\": '",
        pick({1: "null", 9: "null"}, '"churn"'),
        "', \"time_column\": '",
        pick({2: '"date"'}, "null"),
        "'}, \"output_mode\": {\"prediction_type\": \"class_label\", \"target_description\": \"d\", \"output_format\": \"f\"}, "
        "\"evaluation\": {\"primary_metric\": \"f1\", \"validation_strategy\": '",
        pick({8: '""'}, '"holdout"'),
        "'}, \"missing_information\": '",
        pick({5: '["which column"]', 6: '{"critical": [], "optional": ["class shares"]}', 10: '{"critical": [], "optional": ["history"]}'},
             '{"critical": [], "optional": []}'),
        "', \"user_facing_response\": \"fine\"}'",
    ])


TASK_TEXT = _task_text()


def tasks(s, d):
    return taskgate.parse_tasks(orders(s, d).selectExpr("o_orderkey", f"{TASK_TEXT} AS document"), "document")


E, W = fixed.GATE_ERRORS, fixed.GATE_WARNINGS
GATE = {
    # kind: (task type, parsed decision, errors, warnings, normalised decision)
    1: ("classification", "accepted", [E["target_column"].replace("%s", "classification")], [], "need_info"),
    2: ("forecasting", "accepted", [], [W["granularity"]], "need_confirmation"),
    3: ("clustering", "accepted", [], [W["cluster_target"]], "need_confirmation"),
    4: ("unknown", "rejected", [E["task_type"], E["decision"], E["should_model"]], [], "rejected"),
    5: ("classification", "need_info", [E["decision"], E["should_model"], E["critical"]], [], "need_info"),
    6: ("classification", "need_confirmation", [E["decision"], E["should_model"]], [W["optional"]], "need_confirmation"),
    7: ("classification", "accepted", [E["data_type"], E["required_inputs"]], [], "need_info"),
    8: ("classification", "accepted", [], [W["validation"]], "need_confirmation"),
    9: ("forecasting", "accepted", [E["target_column"].replace("%s", "forecasting"), E["time_column"]], [W["granularity"]], "need_info"),
    10: ("classification", "need_confirmation", [E["decision"], E["should_model"]], [W["optional"]], "need_confirmation"),
}


def _gate_case(index: int, default: str) -> str:
    def shown(value) -> str:
        return "|".join(value) if isinstance(value, list) else value
    return f"CASE {TASK_KIND} " + " ".join(f"WHEN {k} THEN '{shown(v[index])}'" for k, v in GATE.items()) + f" ELSE '{default}' END"


def doc_gate(s, d):
    gated = taskgate.gate(tasks(s, d))
    return gated.select(
        "o_orderkey", "task_type", "decision", "can_model",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


def doc_gate_normalised(s, d):
    done = taskgate.normalise(taskgate.gate(tasks(s, d)))
    return done.select(
        "o_orderkey", "decision", "should_model", F.array_join("gaps.critical", "|").alias("critical"),
        F.array_join("gaps.optional", "|").alias("optional"), "response",
    )


def _gate_normalised_sql() -> str:
    # An accepted task with optional gaps always gets the standard text.
    critical, optional, response = {5: "which column"}, {6: "class shares", 10: "history"}, {10: fixed.TASK_RESPONSES["optional"]}
    for k, (_, parsed, errors, warnings, decision) in GATE.items():
        if parsed == "accepted" and decision == "need_info":
            critical[k] = "|".join(errors)
            response[k] = fixed.GATE_NEED_INFO_INTRO + "\n".join(f"{i}. {e}" for i, e in enumerate(errors, 1))
        elif parsed == "accepted":
            optional[k] = "|".join(warnings)
            response[k] = fixed.GATE_CONFIRM_INTRO + "\n".join(f"{i}. {w}" for i, w in enumerate(warnings, 1))

    def case(values: dict[int, str], default: str) -> str:
        return f"CASE {TASK_KIND} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"

    return (
        f"SELECT o_orderkey, {_gate_case(4, 'accepted')} AS decision, {TASK_KIND} = 0 AS should_model, {case(critical, '')} AS critical, "
        f"{case(optional, '')} AS optional, {case(response, 'fine')} AS response FROM orders"
    )


STRICT_KIND = "o_orderkey % 9"
STRICT_FAULTS = {
    1: "task_name cannot be empty", 2: "problem_statement cannot be empty", 3: "unknown field", 4: "input_mode: unknown field",
    5: "input_mode: data_type is not in its vocabulary", 6: "output_mode: prediction_type is not in its vocabulary",
}
STRICT_RESPONSES = {7: fixed.TASK_RESPONSES["need_info"], 8: fixed.TASK_RESPONSES["rejected"]}


def doc_gate_strict(s, d):
    """Documents with one fault of form each, or a blank response; the clerk and statement carry the order's values."""
    def pick(cases, default):
        return f"CASE {STRICT_KIND} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items()) + f" ELSE {default} END"

    text = " || ".join([
        "'{\"task_name\": \"'", pick({1: " "}, "concat('order ', o_orderkey)"), "'\", \"problem_statement\": \"'", pick({2: ""}, "o_orderpriority"),
        "'\", \"task_type\": \"'", pick({8: "unknown"}, "'classification'"), "'\", \"decision\": \"'", pick({7: "need_info"}, "'accepted'"),
        "'\", \"should_model\": true, \"input_mode\": {\"required_inputs\": [\"rows\"], \"target_column\": \"late\", \"'", pick({4: "shape"}, "'data_granularity'"),
        "'\": null, \"data_type\": \"'", pick({5: "banana"}, "'tabular'"), "'\"}, \"output_mode\": {\"target_description\": \"d\", \"output_format\": \"f\", \"prediction_type\": \"'",
        pick({6: "hunch"}, "'class_label'"), "'\"}, \"evaluation\": {\"primary_metric\": \"f1\", \"validation_strategy\": \"holdout\"}, \"'", pick({3: "mood"}, "'raw_user_request'"),
        "'\": \"x\", \"missing_information\": {\"critical\": '", pick({7: "[\"rows\"]"}, "'[]'"), "', \"optional\": []}}'",
    ])
    parsed = taskgate.parse_tasks(orders(s, d, "o_orderpriority").selectExpr("o_orderkey", f"{text} AS document"), "document")
    done = taskgate.normalise(taskgate.gate(parsed))
    return done.select("o_orderkey", F.coalesce("problem", F.lit("")).alias("problem"), "can_model", "should_model", "decision", "response")


def _strict_sql() -> str:
    def case(values, default):
        return f"CASE {STRICT_KIND} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"

    return (
        f"SELECT o_orderkey, {case(STRICT_FAULTS, '')} AS problem, {STRICT_KIND} = 0 AS can_model, {STRICT_KIND} = 0 AS should_model, "
        f"{case({7: 'need_info', 8: 'rejected'}, 'accepted')} AS decision, {case(STRICT_RESPONSES, '')} AS response FROM orders"
    )


def doc_confirm(s, d):
    """Gated tasks are stored; the confirmation comes later."""
    stored = materialize(taskgate.normalise(taskgate.gate(tasks(s, d))), "gated")
    done = taskgate.confirm(stored)
    return done.select("o_orderkey", "decision", "should_model", F.array_join("assumptions", "|").alias("assumptions"), "response")


def _confirm_sql() -> str:
    gaps = {k: w[0] for k, (_, parsed, _, w, d) in GATE.items() if d == "need_confirmation"}
    gaps |= {6: "class shares", 10: "history"}
    whens = " ".join(f"WHEN {k} THEN '{fixed.CONFIRMED_ASSUMPTION}{v}'" for k, v in gaps.items())
    return (
        f"SELECT o_orderkey, 'accepted' AS decision, true AS should_model, CASE {TASK_KIND} {whens} END AS assumptions, "
        f"'{fixed.CONFIRMED_RESPONSE}' AS response FROM orders WHERE {TASK_KIND} IN ({', '.join(map(str, gaps))})"
    )


def doc_decisions(s, d):
    return taskgate.decision_counts(taskgate.normalise(taskgate.gate(tasks(s, d))))


def doc_legacy(s, d):
    return tasks(s, d).select(
        "o_orderkey", F.array_join("gaps.critical", "|").alias("critical"), F.array_join("gaps.optional", "|").alias("optional")
    )


FENCE_SQL = fixed.FENCE_PATTERN
QUERIES = {
    "doc_fences": (
        doc_fences,
        f"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(response, '{FENCE_SQL}', 2), lambda b: trim(b, chr(10) || ' ')), '|') AS blocks, "
        f"CASE kind WHEN 0 THEN '{{\"depth\": ' || conv_id || '}}' WHEN 2 THEN '[' || conv_id || ']' ELSE '' END AS json_blocks FROM ({RESPONSES})",
    ),
    "doc_strip_fence": (
        doc_strip_fence,
        f"SELECT conv_id, turn, CASE WHEN kind = 6 THEN '[{{\"n\": ' || conv_id || '}}]' "
        # one fence pair around the whole text, as the match may run over inner fences
        "WHEN kind = 2 THEN 'abs(' || conv_id || ')' || chr(10) || '```' || chr(10) || '```JSON' || chr(10) || '[' || conv_id || ']' "
        f"ELSE regexp_replace(response, '^\\s+|\\s+$', '', 'g') END AS bare FROM ({RESPONSES})",
    ),
    "doc_json": (doc_json, f"SELECT conv_id, turn, {JSON_TEXT} AS json_text, {JSON_STATUS} AS json_status FROM ({RESPONSES})"),
    "doc_json_yield": (
        doc_json_yield,
        f"SELECT role, count(*) AS responses, count(*) FILTER (status = 'ok') AS usable, round(avg((status = 'ok')::INT), 6) AS yield "
        f"FROM (SELECT role, {JSON_STATUS} AS status FROM ({RESPONSES})) GROUP BY role",
    ),
    "doc_plan_errors": (doc_plan_errors, _plan_errors_sql()),
    "doc_plan_kinds": (
        doc_plan_kinds,
        f"SELECT o_orderkey, o_orderpriority, CASE {PLAN_KIND} " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, _, v) in KIND_FAULTS.items()) + " ELSE '' END AS errors FROM orders",
    ),
    "doc_plan_conflicts": (
        doc_plan_conflicts,
        f"SELECT o_orderkey, unnest(['unknown_column', 'target_in_features', 'id_in_features']) AS problem, "
        "unnest(['feature_columns', 'target_column', 'id_columns']) AS place, unnest(['o_colour', 'o_orderpriority', 'o_orderkey']) AS name "
        f"FROM orders WHERE {PLAN_KIND} = 10",
    ),
    "doc_gate": (
        doc_gate,
        f"SELECT o_orderkey, {_gate_case(0, 'classification')} AS task_type, {_gate_case(1, 'accepted')} AS decision, {TASK_KIND} = 0 AS can_model, "
        f"{_gate_case(2, '')} AS errors, {_gate_case(3, '')} AS warnings FROM orders",
    ),
    "doc_gate_strict": (doc_gate_strict, _strict_sql()),
    "doc_gate_normalised": (doc_gate_normalised, _gate_normalised_sql()),
    "doc_confirm": (doc_confirm, _confirm_sql()),
    "doc_decisions": (
        doc_decisions,
        f"SELECT task_type, decision, count(*) AS tasks FROM (SELECT {_gate_case(0, 'classification')} AS task_type, {_gate_case(4, 'accepted')} AS decision FROM orders) "
        "GROUP BY ROLLUP (task_type, decision)",
    ),
    "doc_legacy": (
        doc_legacy,
        f"SELECT o_orderkey, CASE {TASK_KIND} WHEN 5 THEN 'which column' ELSE '' END AS critical, "
        f"CASE {TASK_KIND} WHEN 6 THEN 'class shares' WHEN 10 THEN 'history' ELSE '' END AS optional FROM orders",
    ),
}

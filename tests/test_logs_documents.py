"""Logs, responses, the task gate and the stream on small fixtures."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tableprep.operators import documents, runlog, taskgate
from tableprep.streaming import live_events

TASK = {
    "task_name": "Frost at the orchard", "task_type": "classification", "decision": "accepted", "should_model": True,
    "problem_statement": "Tell in the evening whether the night brings frost.",
    "input_mode": {"data_type": "tabular", "required_inputs": ["wind", "dew point"], "target_column": "frost"},
    "output_mode": {"prediction_type": "class_label", "target_description": "frost or none", "output_format": "a column"},
    "evaluation": {"primary_metric": "f1", "validation_strategy": "holdout"},
    "missing_information": {"critical": [], "optional": []}, "user_facing_response": "Fine, frost it is.",
}


def gate_of(spark, **changes):
    df = spark.createDataFrame([(json.dumps({**TASK, **changes}),)], "document string")
    return taskgate.normalise(taskgate.gate(taskgate.parse_tasks(df, "document")))


def test_malformed_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([("{cut off",), ("  ",), ('{"llm_call_id": "llm_0031"}',), ('{"llm_call_id": "llm_x9"}',), ("[1",)], "value string")
    rows = runlog.parse_lines(lines, runlog.CALL_SCHEMA)
    assert tuple(runlog.line_quality(rows).first()) == (2, 2)
    assert runlog.next_id(rows, "llm_call_id", "llm").first()["next_id"] == "llm_0032"


def test_next_ids(spark):
    ids = spark.createDataFrame([("probe_0007",), ("run_9999",), ("probe_low",), ("probe_0120",), (None,)], "id string")
    assert {r["prefix"]: r["next_id"] for r in runlog.next_ids(ids, "id").collect()} == {"probe": "probe_0121", "run": "run_10000"}
    assert runlog.next_id(ids, "id", "task").first()["next_id"] == "task_0001"


def test_metric_directions(spark):
    events = spark.createDataFrame(
        [("2023-11-05T06:30:00-02:00", "INFO", "metric_recorded", "t", r, None, "", json.dumps({"split": "test", "metrics": {"f1": f1, "rmse": rmse}}))
         for r, f1, rmse in (("a", 0.61, 12.0), ("b", 0.66, 15.5))], runlog.EVENT_SCHEMA)
    best = {r["metric"]: r["run_id"] for r in runlog.best_runs(runlog.metric_values(events)).collect()}
    assert best == {"f1": "b", "rmse": "a"}


def test_ids_from_paths(spark):
    df = spark.createDataFrame([
        ("file:/t/task_1/runs/run_2/logs/run.jsonl", None, None), ("file:/t/task_1/logs/task.jsonl", None, None), ("file:/t/task_1/logs/task.jsonl", "task_9", "run_8"),
    ], "file_path string, task_id string, run_id string")
    assert [(r["task_id"], r["run_id"]) for r in runlog.complete_ids(df).collect()] == [("task_1", "run_2"), ("task_1", None), ("task_9", "run_8")]


FENCED = "```sql\nSELECT depth FROM wells\n```\n```json\n{\"wells\": 3}\n```"


def test_fences(spark):
    df = spark.createDataFrame([(FENCED,), ("```r\nmean(depth)\n```",)], "t string")
    found = df.select(
        documents.fenced_blocks(F.col("t"), "json").alias("json"), documents.fenced_blocks(F.col("t")).alias("all"), documents.strip_fence(F.col("t")).alias("bare")
    ).collect()
    assert found[0]["json"] == ['{"wells": 3}'] and found[0]["all"] == ["SELECT depth FROM wells", '{"wells": 3}']
    assert found[1]["bare"] == "mean(depth)"


@pytest.mark.parametrize("text, status, found", [
    ('Measured at dawn:\n```json\n{"dew": -1.5}\n```\nas asked', "ok", '{"dew": -1.5}'),
    ('my guess is {"frost": true, "hours": [3, 4, 5]}, give or take', "ok", '{"frost": true, "hours": [3, 4, 5]}'),
    ("clear sky, light wind from the east", "none", None),
    ('{"hours": [3, {"from": 4', "unbalanced", None),
    ("{no quotes}", "invalid", "{no quotes}"),
    ('so {"sign": "} \\" {"} it is', "ok", '{"sign": "} \\" {"}'),
    ("[{\"h\": 3}, {\"h\": 4}] {", "ok", '[{"h": 3}, {"h": 4}]'),
    (None, "none", None),
])
def test_json_in_responses(spark, text, status, found):
    row = documents.extract_json(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row["json_status"], row["json_text"]) == (status, found)


def test_gate_decisions(spark):
    complete = gate_of(spark).first()
    assert complete["can_model"] and complete["decision"] == "accepted"
    no_target = gate_of(spark, input_mode={"data_type": "tabular", "required_inputs": ["wind"], "target_column": None}).first()
    assert no_target["decision"] == "need_info" and not no_target["should_model"] and no_target["gaps"]["critical"]
    forecast = gate_of(
        spark, task_type="forecasting",
        input_mode={"data_type": "time_series", "required_inputs": ["level"], "target_column": "level", "time_column": "read_at", "data_granularity": None},
    ).first()
    assert forecast["decision"] == "need_confirmation" and forecast["errors"] == [] and forecast["gaps"]["optional"] == forecast["warnings"]


def test_inconsistent_tasks_are_named(spark):
    def problem(**changes):
        return gate_of(spark, **changes).first()["problem"]

    assert problem() is None
    assert problem(missing_information={"critical": ["x"], "optional": []}) == "accepted with critical gaps"
    assert problem(decision="need_info") == "need_info without critical gaps"
    assert problem(decision="need_confirmation") == "need_confirmation without optional gaps"
    assert problem(task_type="cooking") == "not a task definition"
    assert problem(missing_information=["legacy"]) == "accepted with critical gaps"
    assert gate_of(spark, task_type="unknown").first()["decision"] == "rejected"


def test_confirmation(spark):
    waiting = gate_of(spark, decision="need_confirmation", missing_information={"critical": [], "optional": ["which nights count"]})
    done = taskgate.confirm(waiting).first()
    assert done["decision"] == "accepted" and done["should_model"] and done["gaps"]["optional"] == [] and done["assumptions"]
    assert taskgate.confirm(gate_of(spark)).count() == 0


def test_late_events_are_dropped(spark, tmp_path):
    def line(minute, level="info", hour=4):
        return json.dumps({"time": f"2023-11-05T{hour:02d}:{minute:02d}:00+00:00", "level": level, "event": " x ", "data": "{}"})

    base = tmp_path / "in"
    base.mkdir()
    counts = live_events.live_counts(live_events.read_event_stream(spark, str(base), files_per_trigger=1), window="10 minutes", lateness="5 minutes")
    for name, lines in (("1.json", [line(1), line(2)]), ("2.json", [line(40)]), ("3.json", [line(3), line(59, hour=5), line(41, "nonsense")])):
        (base / name).write_text("\n".join(lines))
        live_events.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    got = {(str(r["window_start"])[11:16], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("04:00", 2), ("04:40", 1)}


def first_balanced(text):
    """The first balanced bracket, read character by character."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=None)
    if at is None:
        return ""
    opener, depth, quoted, escaped = text[at], 0, False, False
    closer = "}" if opener == "{" else "]"
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            quoted = True
        else:
            depth += (c == opener) - (c == closer)
            if depth == 0:
                return text[at : i + 1]
    return "!"


def test_brackets_balance_as_read_by_character(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice('{}[]"\\a \n😀') for _ in range(draw.randrange(1, 24))) for _ in range(3000)]
    texts += ["", "none", '{"a": "' + "\\\"" * 30_000 + '"} rest', "[" * 5_000 + "]" * 5_000 + "x", '{"q": "' + "long " * 50_000 + '"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    frame = df.select("i", documents.balanced_json(F.col("t")).alias("found"))
    assert "Python" not in frame._jdf.queryExecution().toString()
    found = {r["i"]: r["found"] for r in frame.collect()}
    assert found.pop(-1) is None
    assert found == {i: first_balanced(t) for i, t in enumerate(texts)}

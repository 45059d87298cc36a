"""Logs read as lines are appended to them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tableprep.operators import runlog
from tableprep.streaming import appended_lines
from tableprep.streaming.appended_lines import AppendedLinesReader


def caught_up(spark, base, **options):
    """Run the stream until it has read what is there now; returns all it has written so far."""
    lines = appended_lines.read_appended_lines(spark, f"{base}/tasks", files="*.jsonl", **options)
    writer = lines.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.start(f"{base}/out").awaitTermination()
    return spark.read.schema(lines.schema).parquet(f"{base}/out")


def event(n):
    return json.dumps({"time": f"2024-03-01T10:{n % 60:02d}:00+00:00", "level": "INFO", "event": f"e{n % 4}", "message": "größer " * (n % 5), "data": "{}"}, ensure_ascii=False)


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(text.encode())


@pytest.mark.parametrize("task_bytes", [64 << 20, 37])
def test_appended_lines_are_read_once(spark, tmp_path, task_bytes):
    one, two = tmp_path / "tasks/task_1/logs/task.jsonl", tmp_path / "tasks/task_2/runs/run_1/logs/run.jsonl"
    append(one, "".join(event(n) + "\n" for n in range(20)))
    append(two, event(100) + "\n" + event(101)[:30])  # a line that is still being written
    append(tmp_path / "tasks/other.txt", "no log\n")
    first = caught_up(spark, tmp_path, task_bytes=task_bytes)
    assert first.count() == 21
    append(one, "".join(event(n) + "\n" for n in range(20, 33)) + "\n")
    append(two, event(101)[30:] + "\n")
    append(tmp_path / "tasks/task_3/logs/task.jsonl", "\n" + event(7) + "\n" + "tail without an end")
    lines = caught_up(spark, tmp_path, task_bytes=task_bytes)
    assert caught_up(spark, tmp_path, task_bytes=task_bytes).count() == lines.count()
    want = [event(n) for n in range(33)] + ["", event(100), event(101), "", event(7)]
    assert sorted(r["value"] for r in lines.collect()) == sorted(want)
    assert lines.select("file_path", "begin").distinct().count() == len(want)
    events = runlog.complete_ids(runlog.parse_lines(lines))
    counts = {(r["task_id"], r["run_id"]): r["count"] for r in events.groupBy("task_id", "run_id").count().collect()}
    assert counts == {("task_1", None): 33, ("task_2", "run_1"): 2, ("task_3", None): 1}


def test_stretches_part_a_file_at_any_byte(tmp_path):
    lines = ["", "a", "bc" * 40_000, "", "d\r", "é" * 9]
    append(tmp_path / "x.jsonl", "".join(line + "\n" for line in lines))
    for size in (1, 2, 3, 7, 1000, 1 << 20):
        if size < 7 and len(lines[2]) > 100:
            continue
        reader = AppendedLinesReader({"path": str(tmp_path), "taskbytes": str(size)})
        found = [v for p in reader.partitions({}, reader.latestOffset()) for _, _, v in reader.read(p)]
        assert found == [line.rstrip("\r") for line in lines], size


def test_a_file_that_becomes_shorter_is_an_error(tmp_path):
    append(tmp_path / "x.jsonl", "one\ntwo\n")
    reader = AppendedLinesReader({"path": str(tmp_path)})
    before = reader.latestOffset()
    (tmp_path / "x.jsonl").write_text("one\n")
    with pytest.raises(ValueError, match="became shorter"):
        reader.latestOffset()
    with pytest.raises(ValueError, match="became shorter"):
        AppendedLinesReader({"path": str(tmp_path)}).partitions(before, {str(tmp_path / "x.jsonl"): 4})

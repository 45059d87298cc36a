"""Runs of agents paired across the batches of a stream."""

from __future__ import annotations

import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tableprep.operators import runlog
from tableprep.streaming import live_events, live_runs


def line(second, event, agent="data_agent", task="task_1", run="run_1"):
    time = f"2024-03-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}+00:00"
    return json.dumps({"time": time, "level": "INFO", "event": event, "task_id": task, "run_id": run, "agent": agent, "message": "", "data": "{}"})


def test_runs_across_batches_are_those_of_the_batch_form(spark, tmp_path):
    draw = random.Random(3)
    kinds = [live_runs.START] * 3 + [live_runs.FINISH] * 2 + [live_runs.FAILED]
    rows = sorted((draw.randrange(40_000), draw.choice(kinds), draw.choice("ab"), draw.choice(["t1", "t2", None])) for _ in range(240))
    batches = [rows[:80], rows[80:160], rows[160:]]
    for i in (1, 2):  # some lines come late, within what is allowed
        late = [r for r in batches[i - 1] if r[0] > batches[i][0][0] - 300]
        batches[i - 1] = [r for r in batches[i - 1] if r not in late]
        batches[i] += late
    live_runs.state_store(spark)
    for i, batch in enumerate([*batches, [(86_000, "beat", "z", None)], [(86_399, live_runs.START, "last", None)]]):
        text = "\n".join(line(s, e, a, t) for s, e, a, t in batch)
        if batch[0][1] == "beat":
            text = line(80_000, live_runs.START, "last")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.jsonl").write_text(text + "\n")
        stream = live_runs.live_runs(live_events.read_event_stream(spark, str(tmp_path / "in")), expiry_seconds=10_000)
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).where("agent IN ('a', 'b')")
    events = runlog.parse_lines(spark.createDataFrame([(line(s, e, a, t),) for s, e, a, t in rows], "value string"))
    want = runlog.agent_runs(runlog.normalise(events))
    columns = ["task_id", "run_id", "agent", "attempt", "started", "ended", "outcome"]
    expected = sorted(str(tuple(r)) for r in want.select(*columns[:-1], F.replace("outcome", F.lit("running"), F.lit("expired"))).collect())
    got = found.select(columns).collect()
    # a run without an end for 10,000 seconds has expired by then, whatever came after
    assert sorted(str(tuple(r)) for r in got) == expected


class CountedState:
    """A state variable and the timers of one key, counting what is asked of them."""

    def __init__(self):
        self.held, self.calls, self.timers = None, 0, set()

    def get(self):
        self.calls += 1
        return iter(self.held or []) if isinstance(self.held, list) else self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value

    put = update

    def appendList(self, values):  # noqa: N802
        self.calls, self.held = self.calls + 1, [*(self.held or []), *values]

    def clear(self):
        self.calls, self.held = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 10_000


def test_calls_to_the_state_do_not_grow_with_the_events_of_a_key():
    calls = {}
    for n in (2, 200):
        pairing = live_runs.RunPairing(1_000_000)
        pairing.handle, pairing.early, pairing.open, pairing.attempts = states = [CountedState() for _ in range(4)]
        pairing.early.held = []
        rows = [Row(micros=1000 * i, event=live_runs.FINISH if i % 2 else live_runs.START) for i in range(n)]
        assert list(pairing.handleInputRows(("t", "r", "a"), iter(rows), states[0])) == []
        assert pairing.handle.timers == {0}
        found = list(pairing.handleExpiredTimer(("t", "r", "a"), states[0], None))
        assert [r.attempt for r in found] == list(range(1, n // 2 + 1)) and {r.outcome for r in found} == {"finished"}
        calls[n] = sum(s.calls for s in states)
    assert calls[2] == calls[200]

"""Runs of agents paired as their events arrive: starts wait in state for their ends, across batches.

An event is kept until the watermark has passed it, so that late ones find their place in time. What the watermark has
passed is gone through in order: a start ends with the next end, or is `interrupted` by the next start. A run with no
end within `expiry` of its start is given out as `expired`, and its state goes.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tableprep.operators.runlog import instant, normalise

RUN_SCHEMA = "task_id string, run_id string, agent string, attempt bigint, started timestamp, ended timestamp, seconds double, outcome string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START, FINISH, FAILED = "agent_started", "agent_finished", "agent_failed"


class RunPairing(StatefulProcessor):
    """State of one (task, run, agent): events the watermark has not passed, and the start that is open. Times are
    microseconds; at one time ends come before starts, as in the batch form."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "at bigint, event string")
        self.open = handle.getValueState("open", "at bigint, attempt bigint")
        self.attempts = handle.getValueState("attempts", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        events = [(row.micros, row.event) for row in rows]
        self.early.appendList(events)
        self.handle.registerTimer(-(-min(at for at, _ in events) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        """All that the watermark has passed; one timer waits for the first event of the rest, one for the open start."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((at, event == START, event) for at, event in self.early.get())
        passed = [e for e in waiting if e[0] <= now]
        found = []
        before = began = self.open.get()
        attempt = (self.attempts.get() or (0,))[0] if any(starts for _, starts, _ in passed) else 0
        for at, starts, event in passed:
            if began is not None:
                outcome = "interrupted" if starts else "failed" if event == FAILED else "finished"
                found.append((*began, None if starts else at, outcome))
            began = (at, attempt := attempt + 1) if starts else None
        if began is not None and began[0] + self.expiry_ms * 1000 <= now:
            found.append((*began, None, "expired"))
            began = None
        if attempt:
            self.attempts.update((attempt,))
        if began != before:
            if began is None:
                self.open.clear()
            else:
                self.open.update(began)
                self.handle.registerTimer(-(-began[0] // 1000) + self.expiry_ms)
        if passed:
            rest = [(at, event) for at, _, event in waiting[len(passed) :]]
            self.early.put(rest) if rest else self.early.clear()
            if rest:
                self.handle.registerTimer(-(-rest[0][0] // 1000))
        return _rows(key, found)

    def close(self) -> None:
        pass


def _rows(key, found: list[tuple]) -> Iterator[Row]:
    def time(micros: int | None):
        return None if micros is None else datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=micros)

    for at, attempt, end, outcome in found:
        yield Row(
            task_id=key[0] or None, run_id=key[1] or None, agent=key[2] or None, attempt=attempt, started=time(at), ended=time(end),
            seconds=None if end is None else (end - at) / 1e6, outcome=outcome,
        )


def live_runs(events: DataFrame, *, lateness: str = "10 minutes", expiry_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """A stream of runs, one row per start once it is known how it went: the rows of `agent_runs`, with `expired` where
    nothing followed. Needs the RocksDB state store, see `state_store`. Events later than `lateness` are dropped."""
    timed = normalise(events).where(F.col("event").isin(START, FINISH, FAILED)).withColumn("at", instant()).where(F.col("at").isNotNull())
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in ("task_id", "run_id", "agent")]
    rows = timed.select(*keys, "at", "event").withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("task_id", "run_id", "agent").transformWithState(
        statefulProcessor=RunPairing(expiry_seconds * 1000), outputStructType=RUN_SCHEMA, outputMode="append", timeMode="EventTime"
    )


def state_store(spark) -> None:
    """Choose the state store that timers and lists need, for streams started from now on."""
    spark.conf.set(STATE_STORE, ROCKS_DB)

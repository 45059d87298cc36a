"""Registered queries: run-log analytics over event-log rows derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.catalog.common import read
from tableprep.operators import runlog
from tableprep.session import materialize, scratch_path
from tableprep.streaming import appended_lines, live_events, live_runs

# Expressions both engines share; the day and time text is made by each engine's own function.
EVENT = (
    "CASE event_type WHEN 'view' THEN ' agent_started' WHEN 'click' THEN 'agent_finished' WHEN 'error' THEN 'agent_failed' "
    "WHEN 'purchase' THEN 'metric_recorded ' ELSE 'artifact_written' END"
)
LEVEL = (
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN ' Warning' WHEN 'click' THEN "
    "CASE WHEN user_id % 2 = 0 THEN 'trace' ELSE 'debug' END ELSE 'info' END"
)
TASK = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'task_' || CAST(user_id AS STRING) END"
RUN = "'run_' || CAST(event_id % 5 AS STRING)"
AGENT = "CASE user_id % 3 WHEN 0 THEN 'data_agent' WHEN 1 THEN 'train_agent' ELSE 'evaluation_agent' END"
PATH = "'artifacts/' || event_type || '_' || CAST(user_id % 4 AS STRING)"
DATA = (
    "CASE event_type WHEN 'error' THEN '{\"error_type\":\"Error' || CAST(user_id % 5 AS STRING) || '\",\"error_message\":\"failed\"}' "
    "WHEN 'purchase' THEN '{\"split\":\"test\",\"metrics\":{\"f1\":' || CAST(value AS STRING) || ',\"rmse\":' || CAST(value AS STRING) || '}}' "
    "WHEN 'signup' THEN '{\"artifact_type\":\"model\",\"path\":\"' || " + PATH + " || '\"}' ELSE '{}' END"
)


def log_lines(s, d):
    """JSON lines as a log writer would leave them; some cut short, some blank."""
    rows = read(s, d, "events").selectExpr(
        "event_id", "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+08:00') AS time", f"{LEVEL} AS level", f"{EVENT} AS event",
        f"{TASK} AS task_id", f"{RUN} AS run_id", f"{AGENT} AS agent", "'' AS message", f"{DATA} AS data",
    )
    names = ("time", "level", "event", "task_id", "run_id", "agent", "message")
    whole = F.to_json(F.struct(*names))
    line = F.concat(F.expr("substring(whole, 1, length(whole) - 1)"), F.lit(',"data":'), F.col("data"), F.lit("}"))
    lines = rows.withColumn("whole", whole).select("event_id", line.alias("value"))
    return lines.select(F.expr(
        "CASE WHEN event_id % 17 = 0 THEN '   ' WHEN event_id % 19 = 0 THEN substring(value, 1, 20) ELSE value END"
    ).alias("value"))


LINES = (
    "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'blank' WHEN event_id % 19 = 0 THEN 'bad' ELSE 'good' END AS line, "
    f"date_trunc('second', ts) - INTERVAL 8 HOUR AS moment, upper(trim({LEVEL})) AS level, trim({EVENT}) AS event, {TASK} AS task_id, {RUN} AS run_id, "
    f"{AGENT} AS agent, event_type, user_id, value FROM events"
)
GOOD = f"SELECT * FROM ({LINES}) WHERE line = 'good'"
NORMAL = f"SELECT * FROM ({GOOD}) WHERE level IN ({', '.join(repr(v) for v in fixed.LOG_LEVELS)})"
AT_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def at_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def parsed(s, d):
    rows = runlog.parse_lines(log_lines(s, d))
    return rows.where(F.col(runlog.BAD_LINE).isNull())


def normal(s, d):
    return runlog.normalise(parsed(s, d))


def log_scan(s, d):
    """Lines written under …/task_7/runs/run_3/logs and read back; ids a row lacks come from the path."""
    path = scratch_path(s, "logs") + "/task_7/runs/run_3/logs"
    log_lines(s, d).write.text(path)
    rows = runlog.scan_events(s, path)
    return rows.groupBy("task_id").agg(
        F.count_if(F.col(runlog.BAD_LINE).isNull()).alias("good_lines"), F.count_if(F.col(runlog.BAD_LINE).isNotNull()).alias("bad_lines")
    )


def log_line_quality(s, d):
    return runlog.line_quality(runlog.parse_lines(log_lines(s, d)))


def log_levels(s, d):
    return normal(s, d).groupBy("level", "event").agg(F.count(F.lit(1)).alias("events"))


def log_last_events(s, d):
    return runlog.last_events(normal(s, d)).withColumn("last_time", at_text("last_time"))


def log_durations(s, d):
    return runlog.durations(normal(s, d)).withColumns({"started": at_text("started"), "ended": at_text("ended")})


def log_agent_runs(s, d):
    """One row per start of an agent, restarts included."""
    return runlog.agent_runs(normal(s, d)).withColumns({"started": at_text("started"), "ended": at_text("ended")})


def log_failures(s, d):
    return runlog.failures(normal(s, d))


def log_leaderboard(s, d):
    return runlog.leaderboard(runlog.metric_values(normal(s, d)), 3)


def log_best_runs(s, d):
    return runlog.best_runs(runlog.metric_values(normal(s, d)))


def log_artifacts(s, d):
    return runlog.artifacts(normal(s, d)).withColumn("last_time", at_text("last_time"))


CALL = (
    "'llm_' || CAST(conv_id * 100 + turn AS STRING) AS llm_call_id, 'task_' || CAST(conv_id % 40 AS STRING) AS task_id, "
    "'run_' || CAST(turn % 3 AS STRING) AS run_id, CASE WHEN turn % 2 = 0 THEN 'data_agent' ELSE 'train_agent' END AS agent, "
    "'provider_' || role AS provider, 'model_' || CAST(conv_id % 3 AS STRING) AS model, "
    "CASE WHEN length(text) % 5 = 0 THEN 'failed' ELSE 'success' END AS status, text AS response, "
    "CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text) END AS tokens"
)


def calls(s, d):
    rows = read(s, d, "conversations").selectExpr(*_split_columns(CALL))
    usage = F.when(F.col("tokens").isNotNull(), F.create_map(
        F.lit("input_tokens"), F.col("tokens").cast("double"), F.lit("output_tokens"), F.lit(2.0) * F.col("tokens")
    ))
    lines = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "tokens"], usage.alias("usage"))).alias("value"))
    return runlog.parse_lines(lines, runlog.CALL_SCHEMA)


def _split_columns(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def log_call_usage(s, d):
    out = runlog.call_usage(calls(s, d))
    return out.withColumns({c: F.round(c, 4) for c in ("failure_rate", "mean_response_length")})


def log_correlate(s, d):
    """Call summaries written from the calls, joined back to the calls and to the last event per run."""
    full = calls(s, d)
    event = F.when(F.col("status") == "failed", "llm_call_failed").otherwise("llm_call_finished")
    summaries = full.select("task_id", "run_id", "agent", event.alias("event"), F.to_json(F.struct("llm_call_id", "status")).alias("data"))
    return runlog.correlate(summaries, full, runlog.last_events(normal(s, d)))


STATE = (
    "'task_' || CAST(o_orderkey AS STRING) AS task_id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE NULL END AS status, "
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'accepted' WHEN '2' THEN 'need_info' WHEN '3' THEN 'need_confirmation' ELSE 'rejected' END AS decision, "
    "o_totalprice / 1000 AS duration_seconds"
)


def log_states(s, d):
    rows = read(s, d, "orders").selectExpr(*_split_columns(STATE))
    lines = rows.select(F.to_json(F.struct("task_id", "status", F.struct("decision").alias("requirement"), "duration_seconds")).alias("value"))
    return runlog.state_rollup(runlog.parse_lines(lines, runlog.STATE_SCHEMA)).withColumn("mean_seconds", F.round("mean_seconds", 4))


def _states_sql() -> str:
    def case(i: int) -> str:
        return "CASE decision " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in fixed.TASK_STATES.items()) + " END"
    return (
        f"SELECT coalesce(status, {case(0)}) AS status, {case(1)} AS next_step, count(*) AS tasks, round(avg(duration_seconds), 4) AS mean_seconds "
        f"FROM (SELECT {STATE} FROM orders) GROUP BY 1, 2"
    )


# Padding to four digits must not cut longer numbers.
IDS = (
    "CASE WHEN turn % 5 = 4 THEN role || '_bad' "
    "ELSE role || '_' || lpad(CAST(conv_id AS STRING), greatest(4, length(CAST(conv_id AS STRING))), '0') END"
)


def log_next_ids(s, d):
    return runlog.next_ids(read(s, d, "conversations").select(F.expr(IDS).alias("id")), "id")


def log_next_id(s, d):
    ids = read(s, d, "conversations").select(F.expr(IDS).alias("id"))
    return runlog.next_id(ids, "id", "assistant")


LOG_PATH = (
    "CASE WHEN event_id % 2 = 0 THEN 'file:/x/tasks/task_' || CAST(user_id AS STRING) || '/runs/run_' || CAST(event_id % 5 AS STRING) || '/logs/run.jsonl' "
    "ELSE 'file:/x/tasks/task_' || CAST(user_id AS STRING) || '/logs/task.jsonl' END"
)


def log_path_ids(s, d):
    rows = read(s, d, "events").selectExpr("event_id", f"{TASK} AS task_id", "CAST(NULL AS STRING) AS run_id", f"{LOG_PATH} AS file_path")
    return runlog.complete_ids(rows).select("event_id", "task_id", "run_id")


def log_live_counts(s, d):
    """The log as a stream of files; windows that the watermark has closed."""
    base = scratch_path(s, "stream")
    log_lines(s, d).repartition(4).write.text(f"{base}/in")
    counts = live_events.live_counts(live_events.read_event_stream(s, f"{base}/in"))
    live_events.write_counts(counts, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    out = s.read.schema(counts.schema).parquet(f"{base}/out")
    return out.withColumns({"window_start": at_text("window_start"), "window_end": at_text("window_end")})


def log_live_appended(s, d):
    """Lines read by byte offsets, in two goes of one stream with a restart between them; counted like log_levels."""
    base = scratch_path(s, "appended")
    lines = log_lines(s, d).withColumn("half", F.xxhash64("value") % 2 == 0)
    for half in (True, False, None):
        if half is not None:
            lines.where(F.col("half") == half).select("value").write.mode("append").text(f"{base}/in")
        read_lines = appended_lines.read_appended_lines(s, f"{base}/in", files="part-*")
        writer = read_lines.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
        writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    rows = s.read.schema(read_lines.schema).parquet(f"{base}/out")
    events = runlog.parse_lines(rows)
    return runlog.normalise(events.where(F.col(runlog.BAD_LINE).isNull())).groupBy("level", "event").agg(F.count(F.lit(1)).alias("events"))


BEAT = '{"time": "2190-01-01T00:00:00+00:00", "level": "INFO", "event": "agent_started", "agent": "beat", "data": "{}"}'


def log_live_runs(s, d):
    """The starts and ends of agents as a stream in three batches; a last beat lets the time of all of them pass."""
    base = scratch_path(s, "runs")
    at = F.unix_seconds(F.try_to_timestamp(F.get_json_object("value", "$.time")))
    lines = materialize(log_lines(s, d).where(F.trim("value") != "").withColumn("at", F.coalesce(at, F.lit(0))), "run-lines")
    first, second = lines.where("at > 0").agg(F.percentile_approx("at", [1 / 3, 2 / 3])).first()[0]
    part = F.when(F.col("at") < first, 0).when(F.col("at") < second, 1).otherwise(2)
    before = s.conf.get(live_runs.STATE_STORE)
    live_runs.state_store(s)
    try:
        for batch in range(4):
            rows = lines.where(part == batch).select("value") if batch < 3 else s.createDataFrame([(BEAT,)], "value string")
            rows.write.mode("append").text(f"{base}/in")
            runs = live_runs.live_runs(live_events.read_event_stream(s, f"{base}/in"), expiry_seconds=3650 * 24 * 3600)
            writer = runs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
            writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    finally:
        s.conf.set(live_runs.STATE_STORE, before)
    out = s.read.schema(runs.schema).parquet(f"{base}/out").where("agent <> 'beat'")
    return out.withColumns({"started": at_text("started"), "ended": at_text("ended")})


METRICS = f"""
SELECT task_id, run_id, 'test' AS split, metric, arg_max(value, (moment, value)) AS value
FROM (SELECT *, unnest(['f1', 'rmse']) AS metric FROM ({NORMAL}) WHERE event = 'metric_recorded') GROUP BY task_id, run_id, metric
"""
SIGNED = "CASE metric WHEN 'rmse' THEN value ELSE -value END"
CALLS = f"SELECT {CALL} FROM conversations"

AGENT_RUNS = (
    f"WITH e AS (SELECT task_id, run_id, agent, moment, event, event = 'agent_started' AS starts FROM ({NORMAL}) "
    "WHERE event IN ('agent_started', 'agent_finished', 'agent_failed')), "
    "w AS (SELECT *, lead(moment) OVER o AS m, lead(event) OVER o AS f, count(*) FILTER (starts) OVER o AS attempt FROM e "
    "WINDOW o AS (PARTITION BY task_id, run_id, agent ORDER BY moment, starts, event)) "
    f"SELECT task_id, run_id, agent, attempt, {AT_TEXT.format('moment')} AS started, "
    f"CASE WHEN f <> 'agent_started' THEN {AT_TEXT.format('m')} END AS ended, "
    "CASE WHEN f <> 'agent_started' THEN (epoch_us(m) - epoch_us(moment)) / 1e6 END AS seconds, "
    "CASE WHEN f IS NULL THEN 'running' WHEN f = 'agent_started' THEN 'interrupted' WHEN f = 'agent_failed' THEN 'failed' ELSE 'finished' END AS outcome "
    "FROM w WHERE starts"
)

QUERIES = {
    "log_scan": (
        log_scan,
        f"SELECT CASE WHEN line = 'bad' THEN 'task_7' ELSE coalesce(task_id, 'task_7') END AS task_id, count(*) FILTER (line = 'good') AS good_lines, "
        f"count(*) FILTER (line = 'bad') AS bad_lines FROM ({LINES}) WHERE line <> 'blank' GROUP BY 1",
    ),
    "log_line_quality": (
        log_line_quality,
        f"SELECT count(*) FILTER (line = 'good') AS good_lines, count(*) FILTER (line = 'bad') AS bad_lines FROM ({LINES})",
    ),
    "log_levels": (log_levels, f"SELECT level, event, count(*) AS events FROM ({NORMAL}) GROUP BY level, event"),
    "log_last_events": (
        log_last_events,
        f"SELECT task_id, run_id, arg_max(event, (moment, event, level)) AS last_event, arg_max(level, (moment, event, level)) AS last_level, "
        f"{AT_TEXT.format('max(moment)')} AS last_time, count(*) AS events FROM ({NORMAL}) GROUP BY task_id, run_id",
    ),
    "log_durations": (
        log_durations,
        f"SELECT task_id, run_id, agent, {AT_TEXT.format('started')} AS started, {AT_TEXT.format('ended')} AS ended, "
        "(epoch_us(ended) - epoch_us(started)) / 1e6 AS seconds, CASE WHEN ended IS NULL THEN 'running' WHEN last = 'agent_failed' THEN 'failed' ELSE 'finished' END AS outcome FROM ("
        "SELECT task_id, run_id, agent, min(moment) FILTER (event = 'agent_started') AS started, max(moment) FILTER (event <> 'agent_started') AS ended, "
        "arg_max(event, (moment, event)) FILTER (event <> 'agent_started') AS last "
        f"FROM ({NORMAL}) WHERE event IN ('agent_started', 'agent_finished', 'agent_failed') GROUP BY task_id, run_id, agent)",
    ),
    "log_agent_runs": (
        log_agent_runs,
        AGENT_RUNS,
    ),
    "log_failures": (
        log_failures,
        f"SELECT agent, 'Error' || (user_id % 5) AS error_type, count(*) AS failures, count(DISTINCT task_id) AS tasks "
        f"FROM ({NORMAL}) WHERE level IN ('ERROR', 'CRITICAL') GROUP BY 1, 2",
    ),
    "log_leaderboard": (
        log_leaderboard,
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, split, metric ORDER BY {SIGNED}, run_id) AS rank FROM ({METRICS})) WHERE rank <= 3",
    ),
    "log_best_runs": (
        log_best_runs,
        f"SELECT task_id, split, metric, arg_min(run_id, ({SIGNED}, run_id)) AS run_id, arg_min(value, ({SIGNED}, run_id)) AS value, count(*) AS runs "
        f"FROM ({METRICS}) GROUP BY task_id, split, metric",
    ),
    "log_artifacts": (
        log_artifacts,
        f"SELECT task_id, run_id, 'artifact' AS kind, 'model' AS artifact_type, {PATH} AS path, count(*) AS writes, {AT_TEXT.format('max(moment)')} AS last_time "
        f"FROM ({NORMAL}) WHERE event = 'artifact_written' GROUP BY task_id, run_id, path",
    ),
    "log_call_usage": (
        log_call_usage,
        "SELECT agent, provider, model, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed_calls, round(avg((status = 'failed')::INT), 4) AS failure_rate, "
        "coalesce(sum(tokens), 0)::DOUBLE AS input_tokens, coalesce(sum(2 * tokens), 0)::DOUBLE AS output_tokens, round(avg(length(response)), 4) AS mean_response_length "
        f"FROM ({CALLS}) GROUP BY agent, provider, model",
    ),
    "log_correlate": (
        log_correlate,
        "SELECT c.task_id, c.run_id, c.agent, c.llm_call_id, CASE c.status WHEN 'failed' THEN 'llm_call_failed' ELSE 'llm_call_finished' END AS event, "
        f"c.status AS call_status, c.model, length(c.response) AS response_length, l.last_event FROM ({CALLS}) c LEFT JOIN "
        f"(SELECT task_id, run_id, arg_max(event, (moment, event, level)) AS last_event FROM ({NORMAL}) GROUP BY task_id, run_id) l USING (task_id, run_id)",
    ),
    "log_states": (log_states, _states_sql()),
    "log_next_ids": (
        log_next_ids,
        f"SELECT role AS prefix, role || '_' || lpad((max(conv_id) + 1)::VARCHAR, greatest(4, length((max(conv_id) + 1)::VARCHAR))::INT, '0') AS next_id FROM conversations WHERE turn % 5 <> 4 GROUP BY role",
    ),
    "log_next_id": (
        log_next_id,
        "SELECT 'assistant_' || lpad((max(conv_id) + 1)::VARCHAR, greatest(4, length((max(conv_id) + 1)::VARCHAR))::INT, '0') AS next_id FROM conversations WHERE turn % 5 <> 4 AND role = 'assistant'",
    ),
    "log_path_ids": (
        log_path_ids,
        f"SELECT event_id, coalesce({TASK}, 'task_' || user_id) AS task_id, CASE WHEN event_id % 2 = 0 THEN 'run_' || (event_id % 5) END AS run_id FROM events",
    ),
    "log_live_appended": (log_live_appended, f"SELECT level, event, count(*) AS events FROM ({NORMAL}) GROUP BY level, event"),
    "log_live_runs": (log_live_runs, AGENT_RUNS.replace("'running'", "'expired'")),
    "log_live_counts": (
        log_live_counts,
        f"SELECT {AT_TEXT.format('w')} AS window_start, {AT_TEXT.format('w + INTERVAL 1 HOUR')} AS window_end, level, event, count(*) AS events "
        f"FROM (SELECT *, date_trunc('hour', moment) AS w FROM ({NORMAL})) WHERE w + INTERVAL 1 HOUR <= (SELECT max(moment) - INTERVAL 10 MINUTE FROM ({NORMAL})) GROUP BY w, level, event",
    ),
}

"""Analytics over event logs, model-call records and task states written as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.functions.joins import left_join, lookup

# The fields of the logs.
EVENT_SCHEMA = (
    "time string, level string, event string, task_id string, run_id string, agent string, message string, data string"
)
CALL_SCHEMA = (
    "time string, llm_call_id string, task_id string, run_id string, agent string, provider string, model string, "
    "status string, system_prompt string, prompt string, response string, error string, "
    "usage map<string,double>, metadata string"
)
STATE_SCHEMA = (
    "task_id string, status string, current_agent string, created_at string, updated_at string, "
    "duration_seconds double, input struct<source:string,source_path:string>, "
    "requirement struct<task_name:string,task_type:string,decision:string,should_model:boolean,"
    "critical_missing_information_count:bigint,optional_missing_information_count:bigint>, "
    "error struct<error_type:string,error_message:string>, next_step string, paths map<string,string>"
)
BAD_LINE = "bad_line"
LOWER_IS_BETTER = ("loss", "error", "rmse", "mse", "mae", "mape", "seconds", "duration")


def parse_lines(lines: DataFrame, schema: str = EVENT_SCHEMA, column: str = "value") -> DataFrame:
    """JSON lines as rows. Blank lines are skipped; a malformed line keeps its text in bad_line."""
    full = f"{schema}, {BAD_LINE} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    kept = lines.where(F.trim(F.col(column)) != "")
    parsed = kept.withColumn("row", F.from_json(F.col(column), full, options))
    others = [c for c in lines.columns if c != column]
    return parsed.select(*others, "row.*")


def scan_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, *, files: str = "*") -> DataFrame:
    """Event rows from files or folders, with task and run taken from the path where a row lacks them."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    return complete_ids(parse_lines(lines.select("value", F.col("_metadata.file_path").alias("file_path")), schema))


def complete_ids(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Fill task_id and run_id from …/<task>/runs/<run>/logs/… or …/<task>/logs/…"""
    run = F.nullif(F.regexp_extract(path, r"/runs/([^/]+)/logs/", 1), F.lit(""))
    in_run = F.nullif(F.regexp_extract(path, r"/([^/]+)/runs/[^/]+/logs/", 1), F.lit(""))
    in_task = F.when(run.isNull(), F.nullif(F.regexp_extract(path, r"/([^/]+)/logs/", 1), F.lit("")))
    return df.withColumns({
        "task_id": F.coalesce("task_id", in_run, in_task), "run_id": F.coalesce("run_id", run),
    })


def line_quality(df: DataFrame) -> DataFrame:
    """(good_lines, bad_lines)."""
    return df.agg(
        F.count_if(F.col(BAD_LINE).isNull()).alias("good_lines"), F.count_if(F.col(BAD_LINE).isNotNull()).alias("bad_lines")
    )


def normalise(events: DataFrame) -> DataFrame:
    """Upper-case levels and trimmed events; rows with another level or no event are left out."""
    level, event = F.upper(F.trim("level")), F.trim("event")
    cleaned = events.withColumns({"level": level, "event": event})
    return cleaned.where(F.col("level").isin(*fixed.LOG_LEVELS) & (F.col("event") != ""))


# The shape of the times that log lines carry.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?$"


def instant(column: str = "time") -> Column:
    """The ISO time of a row, offset included, as an instant; null for any other text, a bare year or date included."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(text))


def last_events(events: DataFrame) -> DataFrame:
    """(task_id, run_id, last_event, last_level, last_time, events): where each run stands."""
    at = F.struct(instant().alias("at"), F.col("event"), F.col("level"))
    return events.groupBy("task_id", "run_id").agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("events")).select(
        "task_id", "run_id", F.col("last.event").alias("last_event"), F.col("last.level").alias("last_level"),
        F.col("last.at").alias("last_time"), "events",
    )


def durations(events: DataFrame, start: str = "agent_started", finish: str = "agent_finished", failed: str = "agent_failed") -> DataFrame:
    """Per task, run and agent: first start, last end, seconds between, and the outcome."""
    event, at = F.col("event"), instant()
    ended = event.isin(finish, failed)
    paired = events.where(event.isin(start, finish, failed)).groupBy("task_id", "run_id", "agent").agg(
        F.min(F.when(event == start, at)).alias("started"), F.max(F.when(ended, at)).alias("ended"),
        F.max(F.when(ended, F.struct(at.alias("at"), event.alias("event")))).alias("last"),
    )
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / F.lit(1e6)
    outcome = F.when(F.col("last").isNull(), "running").when(F.col("last.event") == failed, "failed").otherwise("finished")
    return paired.select("task_id", "run_id", "agent", "started", "ended", seconds.alias("seconds"), outcome.alias("outcome"))


def agent_runs(events: DataFrame, start: str = "agent_started", finish: str = "agent_finished", failed: str = "agent_failed") -> DataFrame:
    """One row per start: task, run, agent, attempt, started, ended, seconds, outcome.

    A start ends with the next end before the next start; one followed by another start was `interrupted`, one followed
    by nothing is `running`. Events are put in order within a day; what a day leaves open meets the first event of the
    next day with any, so that a busy agent is not one window. An end without a start has no row.
    """
    key = ["task_id", "run_id", "agent"]
    rows = events.where(F.col("event").isin(start, finish, failed)).select(*key, instant().alias("at"), "event").where("at IS NOT NULL")
    rows = rows.withColumn("day", F.to_date("at"))
    mark = F.struct("at", (F.col("event") == start).alias("starts"), "event")
    within = Window.partitionBy(*key, "day").orderBy("at", F.col("event") == start, "event")
    placed = rows.withColumns({"next": F.lead(mark).over(within), "before": F.count_if(F.col("event") == start).over(within)})
    days = rows.groupBy(*key, "day").agg(F.min(mark).alias("first"), F.count_if(F.col("event") == start).alias("starts"))
    by_day = Window.partitionBy(*key).orderBy("day")  # a row per day
    so_far = F.sum("starts").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*[F.col(k).alias(f"day_{k}") for k in key], F.col("day").alias("of_day"), F.lead("first").over(by_day).alias("later"), F.coalesce(so_far, F.lit(0)).alias("earlier"))
    same = [F.col(k).eqNullSafe(F.col(f"day_{k}")) for k in key]
    starts = placed.where(F.col("event") == start).join(days, [*same, F.col("day") == F.col("of_day")])
    following = F.coalesce("next", "later")
    ends = ~following["starts"]
    ended = F.when(ends, following["at"])
    outcome = F.when(following.isNull(), "running").when(~ends, "interrupted").when(following["event"] == failed, "failed").otherwise("finished")
    seconds = (F.unix_micros(ended) - F.unix_micros("at")) / F.lit(1e6)
    return starts.select(
        *key, (F.col("earlier") + F.col("before")).cast("bigint").alias("attempt"), F.col("at").alias("started"),
        ended.alias("ended"), seconds.alias("seconds"), outcome.alias("outcome"),
    )


def failures(events: DataFrame) -> DataFrame:
    """(agent, error_type, failures, tasks) of ERROR and CRITICAL events. Tasks are counted exactly."""
    wrong = events.where(F.col("level").isin("ERROR", "CRITICAL"))
    typed = wrong.select("agent", F.coalesce(F.get_json_object("data", "$.error_type"), F.lit("unknown")).alias("error_type"), "task_id")
    per_task = typed.groupBy("agent", "error_type", "task_id").agg(F.count(F.lit(1)).alias("n"))
    return per_task.groupBy("agent", "error_type").agg(F.sum("n").alias("failures"), F.count("task_id").alias("tasks"))


def call_usage(calls: DataFrame) -> DataFrame:
    """Calls, failures and token use per agent, provider and model."""
    usage = F.col("usage")
    return calls.groupBy("agent", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "failed").alias("failed_calls"),
        F.avg((F.col("status") == "failed").cast("double")).alias("failure_rate"),
        F.sum(F.coalesce(usage["input_tokens"], F.lit(0.0))).alias("input_tokens"),
        F.sum(F.coalesce(usage["output_tokens"], F.lit(0.0))).alias("output_tokens"),
        F.avg(F.length("response")).alias("mean_response_length"),
    )


def correlate(events: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Call summaries of the task log with the full call and the last state of its run.

    Call ids are unique within a task. `runs` is a last_events result, whose event counts tell
    which runs are hot: those go by broadcast, see `lookup`.
    """
    call_id = F.get_json_object("data", "$.llm_call_id")
    summaries = events.where(F.col("event").isin("llm_call_finished", "llm_call_failed")).withColumn("llm_call_id", call_id)
    full = calls.select("task_id", "llm_call_id", F.col("status").alias("call_status"), "model", F.length("response").alias("response_length"))
    state = runs.where(F.col("task_id").isNotNull() & F.col("run_id").isNotNull()).select("task_id", "run_id", "last_event", "events")
    named = summaries.select("task_id", "run_id", "agent", "llm_call_id", "event")
    return lookup(left_join(named, full, ["task_id", "llm_call_id"]), state, ["task_id", "run_id"], weight="events")


def metric_values(events: DataFrame) -> DataFrame:
    """(task_id, run_id, split, metric, value): the last value recorded."""
    recorded = events.where(F.col("event") == "metric_recorded").select(
        "task_id", "run_id", instant().alias("at"), F.get_json_object("data", "$.split").alias("split"),
        F.explode(F.from_json(F.get_json_object("data", "$.metrics"), "map<string,double>")).alias("metric", "value"),
    )
    last = F.max(F.struct("at", "value"))
    return recorded.where(F.col("value").isNotNull()).groupBy("task_id", "run_id", "split", "metric").agg(
        last.alias("last")
    ).select("task_id", "run_id", "split", "metric", F.col("last.value").alias("value"))


def lower_is_better(metric: Column) -> Column:
    return F.lower(metric).rlike("(" + "|".join(LOWER_IS_BETTER) + ")")


def leaderboard(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The `top` runs per task, split and metric; the rank limit is applied before the shuffle."""
    signed = F.when(lower_is_better(F.col("metric")), F.col("value")).otherwise(-F.col("value"))
    window = Window.partitionBy("task_id", "split", "metric").orderBy(signed, "run_id")
    return metrics.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def best_runs(metrics: DataFrame) -> DataFrame:
    """The best run per task, split and metric, by partial aggregation alone."""
    signed = F.when(lower_is_better(F.col("metric")), F.col("value")).otherwise(-F.col("value"))
    best = F.min(F.struct(signed.alias("signed"), F.col("run_id"), F.col("value")))
    return metrics.groupBy("task_id", "split", "metric").agg(best.alias("best"), F.count(F.lit(1)).alias("runs")).select(
        "task_id", "split", "metric", F.col("best.run_id").alias("run_id"), F.col("best.value").alias("value"), "runs"
    )


def artifacts(events: DataFrame) -> DataFrame:
    """(task_id, run_id, kind, artifact_type, path, writes, last_time): one row per file, not a list per run."""
    kind = F.when(F.col("event") == "generated_code_written", "code").otherwise("artifact")
    written = events.where(F.col("event").isin("artifact_written", "generated_code_written")).select(
        "task_id", "run_id", kind.alias("kind"),
        F.coalesce(F.get_json_object("data", "$.artifact_type"), F.get_json_object("data", "$.code_type")).alias("artifact_type"),
        F.get_json_object("data", "$.path").alias("path"), instant().alias("at"),
    )
    return written.groupBy("task_id", "run_id", "kind", "artifact_type", "path").agg(
        F.count(F.lit(1)).alias("writes"), F.max("at").alias("last_time")
    )


def state_of(decision: Column) -> tuple[Column, Column]:
    """(status, next step) that follow from a decision."""
    status = step = F.lit(None).cast("string")
    for name, (s, n) in fixed.TASK_STATES.items():
        status, step = F.when(decision == name, s).otherwise(status), F.when(decision == name, n).otherwise(step)
    return status, step


def state_rollup(states: DataFrame) -> DataFrame:
    """(status, next_step, tasks, mean_seconds)."""
    status, step = state_of(F.col("requirement.decision"))
    named = states.select(
        F.coalesce("status", status).alias("status"), F.coalesce("next_step", step).alias("next_step"), "duration_seconds"
    )
    return named.groupBy("status", "next_step").agg(
        F.count(F.lit(1)).alias("tasks"), F.avg("duration_seconds").alias("mean_seconds")
    )


def next_ids(df: DataFrame, column: str, *, width: int = fixed.ID_WIDTH) -> DataFrame:
    """(prefix, next_id) after the highest number of each <prefix>_<digits>; other texts are ignored."""
    number = F.regexp_extract(column, r"^(.+)_(\d+)$", 2)
    numbered = df.where(number != "").select(
        F.regexp_extract(column, r"^(.+)_(\d+)$", 1).alias("prefix"), number.cast("decimal(38,0)").alias("number")
    )
    return numbered.groupBy("prefix").agg(F.max("number").alias("last")).select(
        "prefix", _numbered(F.col("prefix"), F.col("last") + 1, width).alias("next_id")
    )


def next_id(df: DataFrame, column: str, prefix: str, *, width: int = fixed.ID_WIDTH, start: int = 1) -> DataFrame:
    """(next_id) for one prefix; `start` when there is none yet."""
    matched = df.where(F.col(column).rlike(rf"^\Q{prefix}\E_\d+$"))
    number = F.regexp_extract(column, r"_(\d+)$", 1).cast("decimal(38,0)")
    return matched.agg(F.max(number).alias("last")).select(
        _numbered(F.lit(prefix), F.coalesce(F.col("last") + 1, F.lit(start).cast("decimal(38,0)")), width).alias("next_id")
    )


def _numbered(prefix: Column, number: Column, width: int) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(prefix, F.lit("_"), padded)

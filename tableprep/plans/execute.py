"""Carrying out a plan document on a table, lazily; only the fitting of parameters runs jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.functions.columns import quoted
from tableprep.functions.hashing import draw
from tableprep.operators import dates, embedding, encode, fitted, missing, scale, split, text
from tableprep.operators.fitted import Fitted, Transform
from tableprep.operators.fitting import Fit, fit_together
from tableprep.plans.checks import plan_errors
from tableprep.session import materialize
from tableprep.sources import sinks

SPLIT = "split"


@dataclass
class Prepared:
    """The prepared rows with a split column, and every fitted step in order."""

    rows: DataFrame
    steps: list[Fitted]
    plan: Mapping[str, Any]
    cast_failures: DataFrame | None = None
    sort_column: str | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)

    def write(self, path: str) -> None:
        """Rows by split, the feature report, the parameters and the plan."""
        spark = self.rows.sparkSession
        rows = dates.sort_index(self.rows, self.sort_column) if self.sort_column else self.rows
        sinks.write_splits(rows, f"{path}/data", split=SPLIT)
        sinks.write_report(sinks.feature_report(spark, self.steps, self.rows), f"{path}/feature_report")
        self.write_preprocessor(f"{path}/parameters")
        described = spark.createDataFrame([(json.dumps(self.plan, ensure_ascii=False, default=str),)], "plan string")
        sinks.write_report(described, f"{path}/metadata")

    def write_preprocessor(self, path: str) -> None:
        """All that `load_preprocessor` needs to do the same to new rows."""
        spark = self.rows.sparkSession
        sinks.write_parameters(spark, self.steps, path)
        about = {"plan": self.plan, "key": self.key, "columns": [c for c in self.rows.columns if c != SPLIT]}
        spark.createDataFrame([(json.dumps(about, ensure_ascii=False, default=str),)], "about string").write.parquet(f"{path}/about")


@dataclass
class Preprocessor:
    """A prepared plan's steps, read back from files."""

    plan: Mapping[str, Any]
    key: list[str]
    columns: list[str]
    steps: list[Fitted]
    functions: Mapping[str, Transform]

    def apply(self, df: DataFrame) -> DataFrame:
        """The plan's columns of new rows, by the parameters that were fitted then. The target may be missing.

        New rows take part in no split: values carried in order come from among them, target-encoded categories take the
        mean over all folds, and rows the plan drops for missing values are dropped. A feature that is missing is an error.
        """
        old = {new: c for c, new in _renames(self.plan.get("column_actions") or []).items()}
        features = [old.get(c, c) for c in self.plan.get("feature_columns") or []]
        if missing_features := [c for c in features if c not in df.columns]:
            raise ValueError(f"the rows lack features of the plan: {missing_features}")
        target = self.plan.get("target_column")
        plan = self.plan if target in df.columns else _without(self.plan, target)
        work = _shaped(df, plan, self.functions, [k for k in self.key if k in df.columns])
        rows = work.keyed().withColumn(SPLIT, F.lit("new"))
        for step in self.steps:
            rows = step.apply(rows)
        return rows.select(*[quoted(c) for c in self.columns if c in rows.columns])


def load_preprocessor(spark: SparkSession, path: str, functions: Mapping[str, Transform] | None = None) -> Preprocessor:
    """Read back what `write_preprocessor` wrote. `functions` supplies the custom steps by group name, as for `prepare`."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    steps = sinks.read_steps(spark, path, functions or {}, new_rows=True)
    return Preprocessor(about["plan"], about["key"], about["columns"], steps, dict(functions or {}))


def check_plan(spark: SparkSession, plan: Mapping[str, Any]) -> None:
    """Raise ValueError with every rule the plan breaks."""
    rows = spark.createDataFrame([(json.dumps(plan),)], "document string")
    errors = plan_errors(rows, "document").first()["errors"]
    if errors:
        raise ValueError("; ".join(errors))


def prepare(
    df: DataFrame,
    plan: Mapping[str, Any],
    *,
    key: list[str] | None = None,
    functions: Mapping[str, Transform] | None = None,
) -> Prepared:
    """Drop, act on columns, drop incomplete rows, split, then fit on the training rows and apply to all.

    `key` identifies a row for hash-based draws (default: the id columns, else all columns).
    `functions` supplies the DataFrame -> DataFrame step for each place a plan says custom,
    by group name.
    """
    check_plan(df.sparkSession, plan)
    if plan["status"] != "executable":
        raise ValueError(f"plan status is {plan['status']}, not executable")
    functions = dict(functions or {})
    key = list(key or plan.get("id_columns") or df.columns)
    work = _shaped(df, plan, functions, key)
    names = [f"{KEY}.{k}" for k in key]
    split_spec = plan.get("split_strategy") or {"strategy": "none"}
    spec = {**split_spec, **{k: work.name(split_spec[k]) for k in ("stratify_column", "time_column") if split_spec.get(k)}}
    work.rows = apply_split(work.rows, spec, names, functions)
    work.whole = spec["strategy"] == "none"
    work.rows = work.keyed()
    if _fits(plan) and not any(t in work.rows.schema.simpleString() for t in UNWRITABLE):
        # every fit and the result read this table, and of it the columns they need
        work.rows = materialize(work.rows.select(*[quoted(c) for c in _read_later(work)]), "split-rows")
    _fill_gaps(work, plan.get("missing_value_plan") or [])
    for item in plan.get("categorical_encoding_plan") or []:
        _encode(work, item)
    for item in plan.get("numeric_scaling_plan") or []:
        _scale(work, item)
    for item in plan.get("text_processing_plan") or []:
        _text(work, item)
    sort_column = None
    for item in plan.get("datetime_processing_plan") or []:
        sort_column = _dates(work, item) or sort_column
    work.settle()

    made: dict[str, list[str]] = {}
    for step in work.steps:
        for source, now in step.outputs.items():
            made[source] = [*now, *[c for c in made.get(source, []) if c != source and c not in now]]
    wanted: list[str] = work.pick(plan.get("id_columns")) if work.resampled else []
    for c in plan.get("feature_columns") or []:
        wanted += made.get(work.name(c), work.pick([c]))
    wanted += work.pick([c for c in (plan.get("time_column"), plan.get("target_column")) if c])
    if work.resampled:
        wanted += [c for step in work.steps for c in step.outputs.get(work.name(plan.get("time_column") or ""), [])]
    kept = [c for c in dict.fromkeys(wanted) if c in work.rows.columns]
    rows = work.rows.select(*[quoted(c) for c in kept], SPLIT)
    return Prepared(rows, work.steps, plan, work.failures, sort_column, key=key)


KEY, ORDER, DRAW = "__key", "__order", "__draw"
FOLD_SEED = 42
# Types that cannot be written as parquet: rows that have them are not written, but made anew by every fit.
UNWRITABLE = ("void", "interval")


def _shaped(df: DataFrame, plan: Mapping[str, Any], functions: Mapping[str, Transform], key: list[str]) -> _Work:
    """The rows before any split: columns dropped, acted upon and named as the plan says, incomplete rows gone."""
    work = _Work(df.withColumn(KEY, F.struct(*[quoted(k) for k in key or df.columns])), plan, functions)
    work.key = list(key or df.columns)
    split_spec = plan.get("split_strategy") or {}
    needed = {split_spec.get("stratify_column"), split_spec.get("time_column"), plan.get("time_column"), *(plan.get("id_columns") or [])}
    # What orders or groups rows stays until the end, where only features, time and target are selected.
    work.rows = work.rows.drop(*[c for c in work.pick(plan.get("drop_columns")) if c not in needed])
    actions = plan.get("column_actions") or []
    work.rows, work.failures = column_actions(work.rows, actions, functions, work.pick)
    work.renamed = _renames(actions)
    for item in plan.get("missing_value_plan") or []:
        present = work.pick(item["columns"])
        if item["strategy"] == "drop_rows":
            work.rows = missing.drop_missing_rows(work.rows, present)
        elif item["strategy"] == "drop_column":
            work.rows = work.rows.drop(*present)
    return work


def _without(plan: Mapping[str, Any], column: str | None) -> dict[str, Any]:
    """The plan for rows that have no such column."""
    out = {**plan, "drop_columns": [c for c in plan.get("drop_columns") or [] if c != column]}
    for group in ("missing_value_plan", "column_actions"):
        out[group] = [{**item, "columns": [c for c in item["columns"] if c != column]} for item in plan.get(group) or []]
    return out


def _fits(plan: Mapping[str, Any]) -> bool:
    """Whether any step of the plan has to be fitted."""
    methods = {item.get(kind) for group, kind in (
        ("missing_value_plan", "strategy"), ("categorical_encoding_plan", "encoding"), ("numeric_scaling_plan", "scaling"), ("text_processing_plan", "method"),
    ) for item in plan.get(group) or []}
    return bool(methods & {"mean", "median", "mode", "one_hot", "ordinal", "frequency", "target", "standard", "minmax", "robust", "tfidf", "embedding"})


def _read_later(work: _Work) -> list[str]:
    """The columns that steps after the split, or the result, can read: all of them where steps are the user's own, or
    where rows are ordered or grouped by their ids."""
    plan, groups = work.plan, ("missing_value_plan", "categorical_encoding_plan", "numeric_scaling_plan", "text_processing_plan", "datetime_processing_plan")
    items = [item for group in groups for item in plan.get(group) or []]
    methods = {item.get(kind) for item in items for kind in ("strategy", "method")}
    if work.functions or methods & {"ffill", "bfill", "resample"}:
        return work.rows.columns
    named = {c for item in items for c in item["columns"]} | {plan.get("target_column"), plan.get("time_column"), *(plan.get("feature_columns") or [])}
    wanted = {work.name(c) for c in named if c} | {SPLIT, ORDER, DRAW}
    return [c for c in work.rows.columns if c in wanted]


def _renames(actions: list) -> dict[str, str]:
    out: dict[str, str] = {}
    for item in actions:
        params = item.get("params") or {}
        if item["action"] == "rename":
            out |= {c: params.get(c, params.get("to")) for c in item["columns"] if params.get(c, params.get("to"))}
    return out


class _Work:
    """The rows on their way through a plan, the steps so far, and those that wait to be fitted.

    Steps that wait read and change columns apart from each other, so all of them can be fitted on the same rows. What
    needs a column that a waiting step changes, or changes one that it reads, has them fitted first: each level of such
    dependences costs one set of scans, however many steps it has.
    """

    def __init__(self, rows: DataFrame, plan: Mapping[str, Any], functions: Mapping[str, Transform]):
        self.rows, self.plan, self.functions = rows, plan, functions
        self.steps: list[Fitted] = []
        self.waiting: list[Fit] = []
        self.key: list[str] = []
        self.failures: DataFrame | None = None
        self.seen: set[str] = set(rows.columns)
        self.renamed: dict[str, str] = {}
        self.whole = self.resampled = False

    def name(self, column: str) -> str:
        """What a column of the plan is called now."""
        return column if column in self.rows.columns else self.renamed.get(column, column)

    def pick(self, columns: list[str] | None) -> list[str]:
        """The columns as they are called now, without those the plan has dropped; unknown ones are an error."""
        changing = {c for fit in self.waiting for c in fit.writes}
        if any(n in changing or n not in self.rows.columns for n in map(self.name, columns or [])):
            self.settle()
        self.seen |= set(self.rows.columns)
        names = [self.name(c) for c in columns or []]
        if unknown := [c for c in names if c not in self.seen]:
            raise ValueError(f"the plan names columns the table does not have: {unknown}")
        return [c for c in names if c in self.rows.columns]

    def fit(self, fit: Fit) -> None:
        """Have a step wait; the columns it reads have been picked."""
        if {c for other in self.waiting for c in (*other.reads, *other.writes)} & set(fit.writes):
            self.settle()
        self.waiting.append(fit)

    def settle(self) -> None:
        """Fit the steps that wait, and apply them."""
        if self.waiting:
            fits, self.waiting = self.waiting, []
            for step in fit_together(self.train(), fits):
                self._apply(step)

    def run(self, step: Fitted, columns: list[str] | None = None, *, touches: list[str] | None = None) -> None:
        """Apply a step that needs no fitting. Of a user's own step on `columns`, whatever new columns it makes are its
        outputs. `touches` names what it changes (default: anything)."""
        if touches is None or {c for fit in self.waiting for c in (*fit.reads, *fit.writes)} & set(touches):
            self.settle()
        before = set(self.rows.columns)
        self._apply(step)
        if columns:
            made = [c for c in self.rows.columns if c not in before]
            step.outputs = {c: [c] if c in self.rows.columns else [] for c in columns}
            step.outputs[columns[0]] += made

    def _apply(self, step: Fitted) -> None:
        self.seen |= set(self.rows.columns)
        self.rows = step.apply(self.rows)
        self.steps.append(step)

    def custom(self, columns: list[str], function: Transform, name: str) -> None:
        self.run(fitted.custom(columns, function, name), columns)

    def train(self) -> DataFrame:
        return self.rows if self.whole else self.rows.where(F.col(SPLIT) == "train")

    def keyed(self) -> DataFrame:
        """The rows with what is drawn from their key, where the plan needs it, in place of the key."""
        drawn = {}
        if any(i["strategy"] in ("ffill", "bfill") for i in self.plan.get("missing_value_plan") or []):
            drawn[ORDER] = F.xxhash64(KEY)
        if any(i["encoding"] == "target" for i in self.plan.get("categorical_encoding_plan") or []):
            drawn[DRAW] = draw([F.col(KEY).getField(k) for k in self.key], FOLD_SEED)
        return self.rows.withColumns(drawn).drop(KEY)


def column_actions(
    df: DataFrame, actions: list, functions: Mapping[str, Transform] | None = None, pick: Callable[[list[str]], list[str]] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """drop, rename (params: {old: new}) and cast (params: type); casts that fail become null and are counted."""
    failures: dict[str, Column] = {}
    source = df
    for item in actions:
        known = item["columns"] if pick is None else pick(item["columns"])
        names, params = [c for c in known if c in df.columns], item.get("params") or {}
        if item["action"] == "drop":
            df = df.drop(*names)
        elif item["action"] == "rename":
            df = df.withColumnsRenamed({c: params.get(c, params.get("to")) for c in names if params.get(c, params.get("to"))})
        elif item["action"] == "cast":
            kind = params.get("type") or params["dtype"]
            failures |= {c: quoted(c).isNotNull() & quoted(c).try_cast(kind).isNull() for c in names}
            df = df.withColumns({c: quoted(c).try_cast(kind) for c in names})
        elif functions and item["action"] in functions:
            df = functions[item["action"]](df)
        else:
            raise ValueError(f"unknown column action: {item['action']}")
    failures = {c: f for c, f in failures.items() if c in source.columns}
    if not failures:
        return df, None
    counted = source.agg(*[F.count_if(f).alias(f"f{i}") for i, f in enumerate(failures.values())])
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"f{i}").alias("failed_casts")) for i, c in enumerate(failures)]
    return df, counted.select(F.inline(F.array(*cells)))


def apply_split(df: DataFrame, spec: Mapping[str, Any], key: list[str], functions: Mapping[str, Transform]) -> DataFrame:
    strategy = spec["strategy"]
    if strategy == "none":
        return df.withColumn(SPLIT, F.lit("full"))
    if strategy == "custom":
        return functions["split_strategy"](df)
    if strategy == "predefined":
        return df if SPLIT in df.columns else split.predefined_split(df, spec.get("stratify_column") or SPLIT)
    shares = split.split_shares(spec.get("train_size"), spec.get("validation_size"), spec.get("test_size"))
    seed = spec.get("random_state")
    seed = fixed.DEFAULT_RANDOM_STATE if seed is None else seed
    if strategy == "time_based":
        return split.time_split(df, spec["time_column"], shares)
    flat = df.withColumns({f"__key_{i}": F.col(k) for i, k in enumerate(key)})
    names = [f"__key_{i}" for i in range(len(key))]
    if strategy == "random":
        done = split.random_split(flat, names, shares, seed=seed)
    else:
        done = split.stratified_split(flat, names, spec["stratify_column"], shares, seed=seed)
    return done.drop(*names)


def _fill_gaps(work: _Work, items: list) -> None:
    statistics: dict[str, str] = {}
    constants: dict[str, Any] = {}
    for item in items:
        names = work.pick(item["columns"])
        strategy = item["strategy"]
        if strategy in ("mean", "median", "mode", "constant"):
            statistics |= {c: strategy for c in names}
            constants |= {c: item.get("fill_value") for c in names}
        elif strategy in ("ffill", "bfill") and names:
            if not work.plan.get("time_column"):
                raise ValueError(f"{strategy} needs a time_column to order the rows by")
            time = work.name(work.plan["time_column"])
            # Rows of one time go by a hash of the key. No value crosses splits, but for those from the past where time splits.
            past_only = strategy == "ffill" and (work.plan.get("split_strategy") or {}).get("strategy") == "time_based"
            group = [*([] if past_only else [SPLIT]), *work.pick(work.plan.get("id_columns"))]
            params = {"columns": names, "order": [time, ORDER], "key": group, "direction": "forward" if strategy == "ffill" else "backward"}
            facts = [fitted.fact(c, strategy, "order", time) for c in names]
            work.run(fitted.make("carry", params, facts=facts, outputs={c: [c] for c in names}), touches=names)
        elif strategy == "custom":
            work.custom(names, work.functions["missing_value_plan"], "missing_value_plan")
    if statistics:
        names = work.pick(list(statistics))
        work.fit(missing.fill_fit(work.rows, {c: statistics[c] for c in names}, constants))


def _encode(work: _Work, item: Mapping[str, Any]) -> None:
    names, params = work.pick(item["columns"]), item.get("params") or {}
    method, unknown = item["encoding"], item.get("handle_unknown", "ignore")
    if method == "none" or not names:
        return
    if method == "drop":
        work.run(fitted.dropped(names), touches=names)
    elif method == "custom":
        work.custom(names, work.functions["categorical_encoding_plan"], "categorical_encoding_plan")
    elif method == "hashing":
        work.run(encode.hashing(names, int(params.get("buckets", 256))), touches=names)
    elif method == "target":
        target = work.pick([work.plan["target_column"]])[0]
        for c in names:
            work.fit(encode.target_fit(c, target, fold_draw=DRAW, training_split=None if work.whole else SPLIT))
    elif method == "one_hot":
        output, limit = params.get("output", "columns"), int(params.get("limit", encode.ONE_HOT_COLUMNS))
        for c in names:
            work.fit(encode.one_hot_fit(c, handle_unknown=unknown, output=output, limit=limit))
    else:
        for c in names:
            work.fit(encode.ordinal_fit(c, handle_unknown=unknown) if method == "ordinal" else encode.frequency_fit(c))


def _scale(work: _Work, item: Mapping[str, Any]) -> None:
    names = work.pick(item["columns"])
    if item["scaling"] == "none" or not names:
        return
    if item["scaling"] == "custom":
        work.custom(names, work.functions["numeric_scaling_plan"], "numeric_scaling_plan")
    else:
        work.fit(scale.scaling_fit(work.rows, names, item["scaling"]))


def _text(work: _Work, item: Mapping[str, Any]) -> None:
    names, params = work.pick(item["columns"]), item.get("params") or {}
    if item["method"] == "none" or not names:
        return
    if item["method"] == "drop":
        work.run(fitted.dropped(names), touches=names)
    elif item["method"] == "tfidf":
        for c in names:
            work.fit(text.tfidf_fit(c, features=int(params.get("features", text.HASHED_FEATURES))))
    elif item["method"] == "embedding" and not {"embedding", "text_processing_plan"} & set(work.functions):
        for c in names:
            work.fit(embedding.embedding_fit(c, dimensions=int(params.get("dimensions", embedding.DIMENSIONS))))
    else:
        name = item["method"] if item["method"] in work.functions else "text_processing_plan"
        work.custom(names, work.functions[name], name)


def _dates(work: _Work, item: Mapping[str, Any]) -> str | None:
    names, params, method = work.pick(item["columns"]), item.get("params") or {}, item["method"]
    if method == "none" or not names:
        return None
    if method == "sort_index":
        return names[0]
    if method == "drop":
        work.run(fitted.dropped(names), touches=names)
    elif method in ("extract_parts", "cyclical"):
        for c in names:
            before = set(work.rows.columns)
            step = fitted.make(method, {"column": c}, facts=[fitted.fact(c, method, "", None)])
            work.run(step, touches=[c])
            step.outputs[c] = [n for n in work.rows.columns if n not in before and n.startswith(f"{c}_")]
    elif method == "resample":
        time = names[0]
        entity = work.pick(work.plan.get("id_columns"))
        work.resampled = True
        options = {"column": time, "unit": params["unit"], "aggregates": params["aggregates"], "key": [SPLIT, *entity]}
        facts = [fitted.fact(time, method, "unit", params["unit"])]
        work.run(fitted.make("resample", options, facts=facts, outputs={time: [time, *params["aggregates"]]}))
    else:
        work.custom(names, work.functions["datetime_processing_plan"], "datetime_processing_plan")
    return None

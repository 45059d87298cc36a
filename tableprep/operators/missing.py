"""Missing values: drop, fill with fitted statistics, and carry forward or backward in order."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import FLOATING, present, quoted, type_class
from tableprep.functions.quantiles import order_chunks
from tableprep.operators.fitted import Fitted, StepData, Transform, fact, make, step_kind
from tableprep.operators.fitting import Answers, Fit, fit_together, value_of
from tableprep.session import materialize

ROWS_PER_CHUNK = 2_000_000
CHUNKS_PER_SEGMENT = 1_000


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns) if columns else df


def fill_fit(df: DataFrame, strategies: Mapping[str, str], constants: Mapping[str, Any] | None = None) -> Fit:
    """Fill values per column: mean, median, mode or constant, of the rows it is fitted on."""
    of = {s: [c for c, t in strategies.items() if t == s] for s in ("mean", "median", "mode", "constant")}

    def build(found: Answers) -> Fitted:
        values: dict[str, dict[str, Any]] = {c: {"value": (constants or {})[c]} for c in of["constant"]}
        values |= {c: {"value": found.scalars[c]} for c in of["mean"]}
        values |= {c: {"value": found.quantiles[c][0]} for c in of["median"]}
        values |= {c: {"text": text, "type": kind, "value": shown} for c, (text, kind, shown) in found.modes.items()}
        for c, value in values.items():
            value["widen"] = strategies[c] in ("mean", "median") and type_class(df.schema[c].dataType) in ("integer", "boolean")
        facts = [fact(c, strategies[c], "fill_value", values[c]["value"]) for c in values]
        return make("fill", {"values": values}, facts=facts, outputs={c: [c] for c in values})

    columns = list(strategies)
    means = {c: F.avg(present(df, c).cast("double")) for c in of["mean"]}
    return Fit(columns, columns, build, scalars=means, modes=of["mode"], quantiles={c: [0.5] for c in of["median"]})


@step_kind("fill")
def _filled(data: StepData) -> Transform:
    def apply(rows: DataFrame) -> DataFrame:
        filled = {}
        for c, known in data.params["values"].items():
            if c not in rows.columns and data.new_rows:
                continue  # the target, which new rows may lack
            target = T.DoubleType() if known["widen"] else rows.schema[c].dataType
            value = value_of(F.lit(known["text"]), known["type"]) if "type" in known else F.lit(known["value"])
            filled[c] = F.coalesce(present(rows, c).cast(target), value.cast(target))
        return rows.withColumns(filled)

    return apply


def fit_fill(df: DataFrame, strategies: Mapping[str, str], constants: Mapping[str, Any] | None = None) -> Fitted:
    """Statistics of all columns at once, see `fill_fit`."""
    return fit_together(df, [fill_fit(df, strategies, constants)])[0]


def fill_in_order(
    df: DataFrame,
    columns: list[str],
    order: list[str],
    *,
    key: list[str] | None = None,
    direction: str = "forward",
    chunks: int | None = None,
    segment: int = CHUNKS_PER_SEGMENT,
) -> DataFrame:
    """Carry the last (or next) known value along `order`, within `key` or over the whole table.

    A window over a key would gather a hot key, or without keys the whole table, in one task.
    So rows are cut into ordered chunks; each (key, chunk) is filled on its own, and what a chunk
    hands to the next travels in a table with one row per (key, chunk), which is scanned as a tree,
    see `_carry`. Gaps before the first known value stay open. Chunks are as many as the rows ask for
    (`chunks` sets their number, `segment` how many of them one window may hold; neither changes the result).
    """
    key = key or []
    if chunks is None:
        chunks = max(1, -(-df.count() // ROWS_PER_CHUNK))
    forward = direction == "forward"
    cut = order_chunks(df, order, chunks, "__chunk", cuts=segment)
    cut = cut.withColumns({c: present(df, c) for c in columns if isinstance(df.schema[c].dataType, FLOATING)})
    along = [F.col(c) if forward else F.col(c).desc() for c in order]
    # keys as text, so that a null key is a group like any other and window and join share one shuffle
    marks = [f"__key_{i}" for i in range(len(key))]
    cut = cut.withColumns({m: F.coalesce(quoted(k).cast("string"), F.lit("\u0000")) for m, k in zip(marks, key)})
    group = [*marks, "__chunk"]
    window = Window.partitionBy(*group).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumns({c: F.last(quoted(c), ignorenulls=True).over(window) for c in columns})
    if chunks <= 1:
        return filled.select([quoted(c) for c in df.columns])

    place = F.struct(*[quoted(o) for o in order])
    known = [
        (F.max_by if forward else F.min_by)(quoted(c), F.when(quoted(c).isNotNull(), place)).alias(f"__last_{i}")
        for i, c in enumerate(columns)
    ]
    ends = materialize(cut.groupBy(*group).agg(*known), "chunk-ends")  # one row per key and chunk, combined before the shuffle
    carried = _carry(ends, marks, [f"__last_{i}" for i in range(len(columns))], forward, segment)
    joined = filled.join(carried, group, "left")
    completed = {c: F.coalesce(quoted(c), F.col(f"__last_{i}")) for i, c in enumerate(columns)}
    return joined.withColumns(completed).select([quoted(c) for c in df.columns])


def _carry(ends: DataFrame, marks: list[str], lasts: list[str], forward: bool, segment: int) -> DataFrame:
    """What reaches each (key, chunk) from the chunks before it: the last value any of them knows.

    Chunks are taken together `segment` at a time. A window over each of these segments gives what comes from within;
    what comes from earlier segments is the same question about a table with one row per (key, segment). So no window
    holds more than `segment` rows, and the number of levels is the logarithm of the number of chunks.
    """
    latest = F.max_by if forward else F.min_by
    step = F.col("__chunk") if forward else F.col("__chunk").desc()
    ranges = ends.agg(F.min("__chunk").alias("low"), F.max("__chunk").alias("high")).first()
    several = ranges["low"] is not None and ranges["high"] // segment > ranges["low"] // segment
    part = F.floor(F.col("__chunk") / segment).cast("long") if several else F.lit(0).cast("long")
    parted = ends.withColumn("__segment", part)
    over = Window.partitionBy(*marks, "__segment").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    within = parted.select(*marks, "__chunk", "__segment", *[F.last(v, ignorenulls=True).over(over).alias(v) for v in lasts])
    if not several:
        return within.drop("__segment")
    upper = parted.groupBy(*marks, "__segment").agg(
        *[latest(F.col(v), F.when(F.col(v).isNotNull(), F.col("__chunk"))).alias(v) for v in lasts]
    )
    upper = materialize(upper.withColumnRenamed("__segment", "__chunk"), "segment-ends")
    before = _carry(upper, marks, lasts, forward, segment)
    before = before.select(*marks, F.col("__chunk").alias("__segment"), *[F.col(v).alias(f"{v}_before") for v in lasts])
    return within.join(before, [*marks, "__segment"], "left").select(
        *marks, "__chunk", *[F.coalesce(F.col(v), F.col(f"{v}_before")).alias(v) for v in lasts]
    )


@step_kind("carry")
def _carried(data: StepData) -> Transform:
    p = data.params

    def apply(rows: DataFrame) -> DataFrame:
        columns = [c for c in p["columns"] if c in rows.columns or not data.new_rows]  # new rows may lack the target
        return fill_in_order(rows, columns, p["order"], key=p["key"], direction=p["direction"]) if columns else rows

    return apply


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, missing_count) from one scan."""
    row = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("missing_count")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def apply_all(df: DataFrame, steps: list[Fitted]) -> DataFrame:
    return reduce(lambda rows, step: step.apply(rows), steps, df)

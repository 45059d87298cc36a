"""Datetime features: parts, cyclical pairs, time order and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import quoted
from tableprep.operators.fitted import StepData, Transform, step_kind

PARTS = ("year", "quarter", "month", "day", "dayofweek", "hour")
# How many steps each part has before it starts again.
PERIODS = {"quarter": 4, "month": 12, "day": 31, "dayofweek": 7, "hour": 24, "minute": 60}


def date_part(column: Column, part: str) -> Column:
    """dayofweek counts from 1 = Sunday."""
    read = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
        "dayofweek": F.dayofweek, "hour": F.hour, "minute": F.minute,
    }
    return read[part](column)


def extract_parts(df: DataFrame, column: str, parts: tuple[str, ...] = PARTS, *, keep: bool = False) -> DataFrame:
    out = df.withColumns({f"{column}_{p}": date_part(quoted(column), p) for p in parts})
    return out if keep else out.drop(column)


def cyclical(df: DataFrame, column: str, parts: tuple[str, ...] = ("month", "dayofweek", "hour"), *, keep: bool = False) -> DataFrame:
    """sin and cos of each part over its period."""
    added = {}
    for p in parts:
        angle = F.lit(2 * math.pi / PERIODS[p]) * date_part(quoted(column), p)
        added |= {f"{column}_{p}_sin": F.sin(angle), f"{column}_{p}_cos": F.cos(angle)}
    out = df.withColumns(added)
    return out if keep else out.drop(column)


def sort_index(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Time order by range partitions sorted within: the files written follow each other in time."""
    ranged = df.repartitionByRange(partitions, quoted(column)) if partitions else df.repartitionByRange(quoted(column))
    return ranged.sortWithinPartitions(quoted(column))


def resample(
    df: DataFrame,
    column: str,
    unit: str,
    aggregates: dict[str, Column],
    *,
    key: list[str] | None = None,
    fill: bool = False,
) -> DataFrame:
    """Aggregate per time unit (and key). With `fill`, units without rows between the first and
    last of a key appear with nulls; rows are combined per task before the shuffle."""
    key = key or []
    bucket = F.date_trunc(unit, quoted(column).cast("timestamp")).alias("bucket")
    rows = df.where(quoted(column).isNotNull())
    out = rows.groupBy(*[quoted(k) for k in key], bucket).agg(*[a.alias(n) for n, a in aggregates.items()])
    if not fill:
        return out
    ends = rows.groupBy(*[quoted(k) for k in key]).agg(
        F.min(F.date_trunc(unit, quoted(column).cast("timestamp"))).alias("first"),
        F.max(F.date_trunc(unit, quoted(column).cast("timestamp"))).alias("last"),
    )
    step = F.expr({"quarter": "interval 3 months", "week": "interval 7 days"}.get(unit, f"interval 1 {unit}"))
    grid = ends.select(*key, F.explode(F.sequence("first", "last", step)).alias("bucket"))
    return grid.join(out, [*key, "bucket"], "left")


@step_kind("extract_parts")
def _parts(data: StepData) -> Transform:
    return lambda rows: extract_parts(rows, data.params["column"])


@step_kind("cyclical")
def _cycles(data: StepData) -> Transform:
    return lambda rows: cyclical(rows, data.params["column"])


@step_kind("resample")
def _resampled(data: StepData) -> Transform:
    """Aggregates are SQL texts by name; the bucket takes the time column's name."""
    p = data.params
    aggregates = {a: F.expr(e) for a, e in p["aggregates"].items()}
    return lambda rows: resample(rows, p["column"], p["unit"], aggregates, key=p["key"]).withColumnRenamed("bucket", p["column"])

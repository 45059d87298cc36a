"""Fitting several steps together: what they need to know about the rows is asked for in as few scans as there are kinds
of questions, not in one or more for each step and column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import FLOATING, present, quoted
from tableprep.functions.quantiles import exact_quantiles
from tableprep.operators.fitted import Fitted
from tableprep.session import materialize


@dataclass
class Fit:
    """A step that is still to be fitted: the columns it reads and changes, its questions, and how answers make it.

    scalars: aggregates by a name of the step's own. counted: columns whose categories are counted. listed: of these, the
    ones whose categories are few enough to be named, with the most there may be. modes: columns whose most frequent value
    is wanted. sums: (column, target, fold) whose target sums by category and fold are wanted. quantiles: shares by column.
    alone: anything that needs a pass of its own.
    """

    reads: list[str]
    writes: list[str]
    build: Callable[[Answers], Fitted]
    scalars: dict[str, Column] = field(default_factory=dict)
    counted: list[str] = field(default_factory=list)
    listed: dict[str, int] = field(default_factory=dict)
    modes: list[str] = field(default_factory=list)
    sums: list[tuple[str, Column, Column]] = field(default_factory=list)
    quantiles: dict[str, list[float]] = field(default_factory=dict)
    alone: Callable[[DataFrame], Any] | None = None


@dataclass
class Answers:
    """What was found for one step, under the names it asked by."""

    scalars: dict[str, Any]
    counts: dict[str, DataFrame]
    categories: dict[str, list[str] | None]
    modes: dict[str, tuple[str | None, str, str | None]]
    sums: list[DataFrame]
    quantiles: dict[str, list[float | None]]
    alone: Any = None


def fit_together(df: DataFrame, fits: list[Fit]) -> list[Fitted]:
    """Fit independent steps on the same rows.

    One aggregate answers all scalars, one written count table all category counts, modes and category lists, one written
    table all target sums, and one series of narrowing scans all quantiles.
    """
    scalars = _scalars(df, fits)
    counted = sorted({c for f in fits for c in (*f.counted, *f.listed)})
    moded = sorted({c for f in fits for c in f.modes})
    cells = [(quoted(c).cast("string")) for c in counted] + [_mode_text(df, c) for c in moded]
    counts = count_cells(df, cells) if cells else None
    per_column = {c: counts.where(F.col("part") == i).drop("part") for i, c in enumerate(counted)}
    limits: dict[int, int] = {}
    for f in fits:
        for c, n in f.listed.items():
            limits[counted.index(c)] = max(n, limits.get(counted.index(c), 0))
    categories = {counted[i]: found for i, found in _listed(counts, limits).items()}
    modes = _modes(df, counts, {len(counted) + i: c for i, c in enumerate(moded)})
    sums = _target_sums(df, [s for f in fits for s in f.sums])
    wanted: dict[str, list[float]] = {}
    for f in fits:
        for c, shares in f.quantiles.items():
            wanted[c] = sorted({*wanted.get(c, []), *shares})
    found = exact_quantiles(df, wanted)
    values = {c: dict(zip(wanted[c], found[c])) for c in wanted}

    out, taken = [], 0
    for i, f in enumerate(fits):
        own = sums[taken : taken + len(f.sums)]
        taken += len(f.sums)
        out.append(f.build(Answers(
            scalars[i], {c: per_column[c] for c in (*f.counted, *f.listed)},
            {c: None if categories[c] is None or len(categories[c]) > n else categories[c] for c, n in f.listed.items()},
            {c: modes[c] for c in f.modes}, own, {c: [values[c][s] for s in shares] for c, shares in f.quantiles.items()},
            f.alone(df) if f.alone else None,
        )))
    return out


def _scalars(df: DataFrame, fits: list[Fit]) -> list[dict[str, Any]]:
    named = [(i, name, column) for i, f in enumerate(fits) for name, column in f.scalars.items()]
    out: list[dict[str, Any]] = [{} for _ in fits]
    if named:
        row = df.agg(*[column.alias(f"s{n}") for n, (_, _, column) in enumerate(named)]).first()
        for n, (i, name, _) in enumerate(named):
            out[i][name] = row[n]
    return out


def count_cells(df: DataFrame, cells: list[Column]) -> DataFrame:
    """A written (part, category, n) table of the non-null values of several texts, all from one scan."""
    structs = [F.struct(F.lit(i).alias("part"), c.alias("category")) for i, c in enumerate(cells)]
    rows = df.select(F.inline(F.array(*structs))).where(F.col("category").isNotNull())
    return materialize(rows.groupBy("part", "category").agg(F.count(F.lit(1)).alias("n")), "categories")


def _listed(counts: DataFrame | None, limits: dict[int, int]) -> dict[int, list[str] | None]:
    """The categories of each part that has at most its limit of them, sorted by their bytes; None for the others."""
    if not limits:
        return {}
    of_limits = counts.where(F.col("part").isin(list(limits)))
    sizes = {r["part"]: r["count"] for r in of_limits.groupBy("part").count().collect()}
    small = [p for p, limit in limits.items() if sizes.get(p, 0) <= limit]
    found: dict[int, list[str] | None] = {p: [] if p in small else None for p in limits}
    for r in counts.where(F.col("part").isin(small)).select("part", "category").collect():
        found[r["part"]].append(r["category"])
    return {p: None if c is None else sorted(c, key=str.encode) for p, c in found.items()}


def _mode_text(df: DataFrame, name: str) -> Column:
    """A text that stands for the value and leads back to it."""
    kind, column = df.schema[name].dataType, present(df, name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, FLOATING):
        column = column + F.lit(0.0).cast(kind)  # one zero, not two
    if not isinstance(kind, T.AtomicType) or isinstance(kind, T.BinaryType):
        raise ValueError(f"{name}: no mode of {kind.simpleString()} values")
    return column.cast("string")


def value_of(text: Column, kind: str) -> Column:
    """The value that `_mode_text` wrote, in the type of that name."""
    return F.timestamp_micros(text.cast("long")) if kind == "timestamp" else text.cast(kind)


def _modes(df: DataFrame, counts: DataFrame | None, parts: dict[int, str]) -> dict[str, tuple[str | None, str, str | None]]:
    """Per column its most frequent value, the smallest on ties: (text, type, text to show); one aggregate for all."""
    if not parts:
        return {}
    picked = []
    for part, c in parts.items():
        kind = df.schema[c].dataType.simpleString()
        value = value_of(F.col("category"), kind)
        mine = F.when(F.col("part") == part, F.struct(-F.col("n"), value))
        picked.append(F.min_by(F.struct(F.col("category").alias("text"), value.cast("string").alias("shown")), mine).alias(f"p{part}"))
    row = counts.where(F.col("part").isin(list(parts))).agg(*picked).first()
    out = {}
    for part, c in parts.items():
        best = row[f"p{part}"]
        out[c] = (best["text"] if best else None, df.schema[c].dataType.simpleString(), best["shown"] if best else None)
    return out


def _target_sums(df: DataFrame, wanted: list[tuple[str, Column, Column]]) -> list[DataFrame]:
    """Per (column, target, fold) a written table (category, fold, n, total), all from one scan."""
    if not wanted:
        return []
    structs = [
        F.struct(F.lit(i).alias("part"), quoted(c).cast("string").alias("category"), fold.cast("int").alias("fold"), target.cast("double").alias("y"))
        for i, (c, target, fold) in enumerate(wanted)
    ]
    rows = df.select(F.inline(F.array(*structs))).where(F.col("category").isNotNull() & F.col("y").isNotNull())
    sums = materialize(rows.groupBy("part", "category", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")), "target_sums")
    return [sums.where(F.col("part") == i).drop("part") for i in range(len(wanted))]

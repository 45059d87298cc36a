"""Exact order statistics and ordered chunks without gathering a column in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import TEMPORAL, present, quoted
from tableprep.session import materialize

GATHER_LIMIT = 50_000
ACCURACY = 10_000
NULL_PLACE = -1.7e308
# Cuts of one pass over a whole table, and of one chunk when it is cut again.
CUTS = 1_000
FINER = 64


def ordered_number(df: DataFrame, name: str) -> Column:
    """A numeric form that keeps the order; times become microseconds."""
    column = present(df, name)
    if isinstance(df.schema[name].dataType, TEMPORAL):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return column.cast("int")
    return column


@dataclass
class _Target:
    """The element of that rank lies strictly between low and high; `below` elements come before."""

    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    @property
    def found(self) -> bool:
        return self.value is not None

    def inside(self, x: Column) -> Column:
        keep = x.isNotNull()
        if self.low is not None:
            keep &= x > F.lit(self.low)
        if self.high is not None:
            keep &= x < F.lit(self.high)
        return keep


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    *,
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of several columns.

    Each round guesses, from a sample, a bracket around every wanted rank and counts what lies
    below, on and between its ends, so a bracket shrinks some hundredfold per scan. Values are
    gathered only once a bracket holds at most `gather_limit` of them. The counts alone decide, so
    neither the guess nor ties of any size can change the result.
    """
    names = list(wanted)
    if not names:
        return {}
    columns = [ordered_number(df, n).cast("double").alias(f"q{i}") for i, n in enumerate(names)]
    base = df.select(columns)
    sizes = base.agg(*[F.count(f"q{i}").alias(f"q{i}") for i in range(len(names))]).first()

    targets: dict[tuple[int, int], _Target] = {}
    for i, name in enumerate(names):
        for p in wanted[name] if sizes[i] else []:
            for rank in _neighbours(sizes[i], p):
                targets.setdefault((i, rank), _Target(rank, sizes[i]))

    while pending := {k: t for k, t in targets.items() if not t.found}:
        small = {k: t for k, t in pending.items() if t.size <= gather_limit}
        if small:
            _gather(base, small)
        large = {k: t for k, t in pending.items() if t.size > gather_limit}
        if large:
            _narrow(base, large)

    result: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        values: list[float | None] = []
        for p in wanted[name]:
            if not sizes[i]:
                values.append(None)
                continue
            low, high = (targets[i, rank].value for rank in _neighbours(sizes[i], p))
            share = (sizes[i] - 1) * p - math.floor((sizes[i] - 1) * p)
            values.append(low + (high - low) * share if share else low)
        result[name] = values
    return result


def _neighbours(size: int, p: float) -> tuple[int, int]:
    spot = (size - 1) * p
    return math.floor(spot), math.ceil(spot)


def _clusters(targets: dict[tuple[int, int], _Target]) -> dict[int, list[tuple[int, _Target]]]:
    """Targets that share column and bracket and lie next to each other share one guess."""
    groups: dict[tuple, list] = {}
    for (column, rank), t in sorted(targets.items()):
        for key, near in groups.items():
            if key[0] == column and near[0][1].low == t.low and near[0][1].high == t.high and rank - key[1] <= 1:
                near.append((column, t))
                break
        else:
            groups[column, rank] = [(column, t)]
    return dict(enumerate(groups.values()))


def _unfolded(base: DataFrame, clusters: dict[int, list[tuple[int, _Target]]]) -> DataFrame:
    """One row (id, x) for every value inside the bracket of a cluster."""
    cells = []
    for number, near in clusters.items():
        column, t = near[0]
        x = F.col(f"q{column}")
        cells.append(F.struct(F.lit(number).alias("id"), F.when(t.inside(x), x).alias("x")))
    return base.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull())


def _gather(base: DataFrame, targets: dict[tuple[int, int], _Target]) -> None:
    clusters = _clusters(targets)
    ordered = F.sort_array(F.collect_list("x")).alias("xs")
    ranks = {n: [t.rank - t.below for _, t in near] for n, near in clusters.items()}
    wanted = F.create_map(*[
        part for n, r in ranks.items() for part in (F.lit(n), F.array(*[F.lit(x) for x in r]))
    ])
    picked = _unfolded(base, clusters).groupBy("id").agg(ordered).select(
        "id", F.transform(F.element_at(wanted, F.col("id")), lambda k: F.get("xs", k)).alias("values")
    )
    for row in picked.collect():
        for (_, t), value in zip(clusters[row["id"]], row["values"]):
            t.value = value


def _narrow(base: DataFrame, targets: dict[tuple[int, int], _Target]) -> None:
    clusters = _clusters(targets)
    wanted = min(max(max(t.size for t in targets.values()) // 20, 20_000), 20_000_000)
    fraction = min(1.0, wanted / min(t.size for t in targets.values()))
    margin = max(1.5 / math.sqrt(wanted), 2.0 / ACCURACY)
    shares = []
    for near in clusters.values():
        t = near[0][1]
        p = (t.rank - t.below) / (t.size - 1)
        shares.append((max(p - margin, 0.0), min(p + margin, 1.0)))
    sampled = base if fraction >= 1.0 else base.sample(fraction, seed=42)
    points = sorted({p for pair in shares for p in pair})
    guess = F.percentile_approx("x", points, ACCURACY).alias("g")
    guesses = {r["id"]: r["g"] for r in _unfolded(sampled, clusters).groupBy("id").agg(guess).collect()}
    ends = {}
    for number, pair in enumerate(shares):
        if number in guesses:
            ends[number] = [guesses[number][points.index(p)] for p in pair]
    missed = {n: near for n, near in clusters.items() if n not in ends}
    if missed:
        extremes = _unfolded(base, missed).groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("z"))
        ends |= {r["id"]: [r["a"], r["z"]] for r in extremes.collect()}

    bounds = F.create_map(*[
        part for n, pair in ends.items() for part in (F.lit(n), F.array(*[F.lit(float(e)) for e in pair]))
    ])
    low, high = (F.element_at(F.element_at(bounds, F.col("id")), i) for i in (1, 2))
    x = F.col("x")
    zoned = _unfolded(base, clusters).select("id", x, low.alias("low"), high.alias("high"))
    counted = zoned.groupBy("id").agg(
        F.count_if(x < F.col("low")).alias("before"),
        F.count_if(x == F.col("low")).alias("on_low"),
        F.count_if((x > F.col("low")) & (x < F.col("high"))).alias("between"),
        F.count_if((x == F.col("high")) & (x > F.col("low"))).alias("on_high"),
    )
    for row in counted.collect():
        for _, t in clusters[row["id"]]:
            _settle(t, *ends[row["id"]], row["before"], row["on_low"], row["between"], row["on_high"])


def _settle(t: _Target, low, high, before: int, on_low: int, between: int, on_high: int) -> None:
    rank, used = t.rank - t.below, before + on_low + between + on_high
    if rank < before:
        t.high, t.size = low, before
    elif rank < before + on_low:
        t.value = low
    elif rank < before + on_low + between:
        t.low, t.high, t.size = low, high, between
        t.below += before + on_low
    elif rank < used:
        t.value = high
    else:
        t.low, t.size = high, t.size - used
        t.below += used


def order_chunks(df: DataFrame, order: list[str], chunks: int, name: str, *, cuts: int = CUTS) -> DataFrame:
    """Add a chunk number that never falls along `order` and spreads rows evenly.

    One pass makes at most `cuts` chunks; beyond that, chunks of more than twice their share of the rows are cut again
    by their own quantiles, FINER pieces at a time, as long as that parts any.
    """
    out = _first_chunks(df, order, min(chunks, cuts), name)
    parted = 0
    while chunks > cuts:
        table = _chunk_cuts(out, order, name)
        sizes = table.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        if not sizes["rows"] or sizes["most"] * chunks <= 2 * sizes["rows"] or sizes["chunks"] == parted:
            break
        parted = sizes["chunks"]
        out = _cut_again(out, order, table, sizes["rows"] / chunks, name)
    return out


def _places(df: DataFrame, order: list[str]) -> list[Column]:
    return [F.coalesce(ordered_number(df, o).cast("double"), F.lit(NULL_PLACE)) for o in order[:2]]


def _chunk_cuts(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """One written row a chunk: its rows, and quantiles of the first order column, or of the second where the first has
    but one value."""
    steps = [i / FINER for i in range(1, FINER)]
    places = _places(df, order)
    marked = df.select(quoted(name).alias("chunk"), *[p.alias(f"v{i}") for i, p in enumerate(places)])
    found = [F.percentile_approx(f"v{i}", steps, ACCURACY).alias(f"cuts{i}") for i in range(len(places))]
    table = marked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("v0").alias("low"), F.max("v0").alias("high"), *found)
    first = F.col("low") < F.col("high")
    second = F.col("cuts1") if len(places) > 1 else F.array().cast("array<double>")
    return materialize(table.select("chunk", "n", first.alias("first"), F.when(first, F.col("cuts0")).otherwise(second).alias("cuts")), "chunk-cuts")


def _cut_again(df: DataFrame, order: list[str], table: DataFrame, share: float, name: str) -> DataFrame:
    """Chunks of more than twice `share` rows in about as many pieces as they have shares, the others as they are."""
    pieces = F.when(F.col("n") > 2 * share, F.least(F.ceil(F.col("n") / share), F.lit(FINER))).otherwise(1)
    some = F.filter("cuts", lambda c, i: F.floor((i + 1) * pieces / FINER) > F.floor(i * pieces / FINER))
    # a quantile that repeats is a hot value, which is parted from what comes after it too
    hot = F.when(F.col("n") > 2 * share, F.filter("cuts", lambda c, i: c == F.get("cuts", i - 1))).otherwise(F.array())
    side = table.select(
        F.col("chunk").alias(f"{name}_own"), F.col("first").alias(f"{name}_first"), F.array_distinct(some).alias(f"{name}_cuts"), F.array_distinct(hot).alias(f"{name}_hot")
    )
    places = _places(df, order)
    value = F.when(F.col(f"{name}_first"), places[0]).otherwise(places[-1])
    # a row for each chunk so far, whose number has no bound
    joined = df.join(F.broadcast(side) if is_few(table) else side.hint("merge"), quoted(name) == F.col(f"{name}_own"))
    fine = F.size(F.filter(f"{name}_cuts", lambda c: c <= value)) + F.size(F.filter(f"{name}_hot", lambda c: c < value))
    numbered = joined.withColumn(name, quoted(name) * F.lit(2 * FINER + 1) + fine)
    return numbered.drop(f"{name}_own", f"{name}_first", f"{name}_cuts", f"{name}_hot")


def is_few(table: DataFrame, rows: int = 10_000) -> bool:
    """Whether a written table is small enough to be broadcast, by its counted rows."""
    return table.limit(rows + 1).count() <= rows


def _first_chunks(df: DataFrame, order: list[str], chunks: int, name: str) -> DataFrame:
    """Chunks from one pass.

    Bounds are quantiles of the first order column, so a group that holds a third of all rows is
    still cut into about a third of the chunks. A value of that column that is itself hot is cut
    further by the second order column.
    """
    if chunks <= 1:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    # nulls sort first; as a value of their own they are cut further when there are many
    first = F.coalesce(ordered_number(df, order[0]).cast("double"), F.lit(NULL_PLACE))
    steps = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(first, steps, max(ACCURACY, 4 * chunks))).first()[0] or []
    repeats = {b: bounds.count(b) for b in bounds}
    cuts = sorted(b for b in repeats if math.isfinite(b))
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    coarse = f"{name}_coarse"
    out = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=f"{name}_value", outputCol=coarse,
        handleInvalid="keep",
    ).transform(df.withColumn(f"{name}_value", first))

    hot = [b for b, n in repeats.items() if n > 1]
    fine: Column = F.lit(0)
    if hot and len(order) > 1:
        second = ordered_number(df, order[1]).cast("double")
        most = max(repeats.values())
        finer = F.percentile_approx("w", [i / (most + 1) for i in range(1, most + 1)], ACCURACY).alias("b")
        crowded = df.select(first.alias("v"), second.alias("w")).where(F.col("v").isin(hot))
        inner = {r["v"]: r["b"] for r in crowded.groupBy("v").agg(finer).collect()}  # at most a row per chunk
        table = df.sparkSession.createDataFrame(
            [(v, sorted(set(b))) for v, b in inner.items() if b], f"{name}_hot double, {name}_cuts array<double>"
        )
        out = out.join(F.broadcast(table), F.col(f"{name}_value") == F.col(f"{name}_hot"), "left")
        fine = F.when(
            F.col(f"{name}_cuts").isNotNull(),
            F.size(F.filter(f"{name}_cuts", lambda b: b <= F.coalesce(second, F.lit(-math.inf)))),
        ).otherwise(F.lit(chunks + 1))
        out = out.withColumn(name, F.col(coarse).cast("bigint") * (chunks + 2) + fine)
        return out.drop(coarse, f"{name}_value", f"{name}_hot", f"{name}_cuts")
    return out.withColumn(name, F.col(coarse).cast("bigint")).drop(coarse, f"{name}_value")

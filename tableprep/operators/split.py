"""Train, validation and test splits that depend on row values only, never on partitioning."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.functions.columns import quoted
from tableprep.functions.hashing import drawn_below, seeded_digest
from tableprep.functions.joins import lookup
from tableprep.functions.quantiles import exact_quantiles, ordered_number
from tableprep.session import materialize

NAMES = ("train", "validation", "test")
DIGEST_PREFIX = 4
ROWS_PER_PREFIX = 1_000_000  # hashes of one class under one prefix that a window may rank


def split_shares(train: float | None, validation: float | None, test: float | None) -> list[tuple[str, float]]:
    """(name, cumulative upper share). Whatever no size claims goes to test, or to train if only that is left."""
    sizes = dict(zip(NAMES, (train, validation, test)))
    given = {n: s for n, s in sizes.items() if s is not None}
    if any(not 0 < s < 1 for s in given.values()):
        raise ValueError(fixed.PLAN_ERRORS["size_range"])
    if sum(given.values()) > 1.0:
        raise ValueError(fixed.PLAN_ERRORS["size_sum"])
    if not given:
        given = {"train": 0.8}
    rest = 1.0 - sum(given.values())
    if rest > 1e-9:
        spare = next((n for n in ("test", "validation", "train") if n not in given), "unassigned")
        given[spare] = rest
    order = [n for n in (*NAMES, "unassigned") if n in given]
    bounds, total = [], 0.0
    for n in order:
        total += given[n]
        bounds.append((n, 1.0 if n == order[-1] else round(total, 12)))
    return bounds


def _label(below: list[tuple[str, Column]], last: str) -> Column:
    chain = None
    for name, condition in below:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return F.lit(last) if chain is None else chain.otherwise(last)


def random_split(df: DataFrame, key: list[str], shares: list[tuple[str, float]], *, seed: int = fixed.DEFAULT_RANDOM_STATE, out: str = "split") -> DataFrame:
    """Bucket of a hash of seed and key: a projection, no shuffle."""
    drawn = [quoted(k) for k in key]
    return df.withColumn(out, _label([(n, drawn_below(drawn, seed, upper)) for n, upper in shares[:-1]], shares[-1][0]))


def stratified_split(df: DataFrame, key: list[str], stratum: str, shares: list[tuple[str, float]], *, seed: int = fixed.DEFAULT_RANDOM_STATE, out: str = "split") -> DataFrame:
    """Exact shares per class, by rank of a hash of the key within the class; copies stay together.

    Classes are large, so no window runs over one. Counts per (class, hash prefix) locate the
    prefix that holds each cut; only hashes under those prefixes are ranked, as counts per hash.
    The result is a table of cut hashes per class, and splitting is a lookup and a comparison.
    """
    digest = seeded_digest([quoted(k) for k in key], seed)
    cuts = stratified_cuts(df, digest, stratum, shares)
    found = lookup(df.withColumn("__digest", digest).withColumn("__class", F.coalesce(quoted(stratum).cast("string"), F.lit("\u0000"))), cuts, ["__class"], weight="__n")
    below = [(n, F.col("__digest") < F.col(f"__cut_{i}")) for i, (n, _) in enumerate(shares[:-1])]
    labelled = found.withColumn(out, _label(below, shares[-1][0]))
    return labelled.select(*[c for c in df.columns], out)


def stratified_cuts(df: DataFrame, digest: Column, stratum: str, shares: list[tuple[str, float]]) -> DataFrame:
    """(__class, __n, __cut_i): rows whose hash is below __cut_i belong to one of the first i+1 splits."""
    rows = df.select(
        F.coalesce(quoted(stratum).cast("string"), F.lit("\u0000")).alias("__class"), digest.alias("digest")
    )
    length = DIGEST_PREFIX
    while True:
        keyed = rows.withColumn("prefix", F.substring("digest", 1, length))
        tally = materialize(keyed.groupBy("__class", "prefix").agg(F.count(F.lit(1)).alias("n")), "strata")
        most = tally.agg(F.max("n")).first()[0] or 0
        if most <= ROWS_PER_PREFIX or length >= 2 * DIGEST_PREFIX:
            break
        length += max(1, math.ceil(math.log(most / ROWS_PER_PREFIX, 16)))
    rows = keyed
    per_class = Window.partitionBy("__class")  # at most 16^length rows per class, and as many as its hashes need
    upto = per_class.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    summed = tally.select(
        "__class", "prefix", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(per_class).alias("__n")
    )
    sizes = summed.groupBy("__class").agg(F.max("__n").alias("__n"))
    if not shares[:-1]:
        return sizes
    cuts = [
        # in decimals: a share of doubles can fall just short of a half, and its cut a row too early
        F.struct(F.lit(i).alias("cut"), F.floor(F.col("__n") * F.lit(Decimal(str(u))) + F.lit(Decimal("0.5"))).cast("bigint").alias("rank"))
        for i, (_, u) in enumerate(shares[:-1])
    ]
    placed = summed.select("*", F.explode(F.array(*cuts)).alias("at"))
    rank = F.col("at.rank")
    holding = placed.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).select(
        "__class", "prefix", F.col("at.cut").alias("cut"), (rank - (F.col("upto") - F.col("n"))).alias("skip")
    )
    holding = materialize(holding, "cut_prefixes")
    ranked = lookup(rows, holding.groupBy("__class", "prefix").agg(F.lit(1).alias("weight"), F.collect_list(F.struct("cut", "skip")).alias("cuts")), ["__class", "prefix"], weight="weight")
    hashes = ranked.where(F.col("cuts").isNotNull()).groupBy("__class", "prefix", "cuts", "digest").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__class", "prefix").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    firsts = offsets.select("__class", "digest", "before", F.explode("cuts").alias("at")).where(
        F.col("before") >= F.col("at.skip")
    )
    # no hash at or after the cut under its prefix: the cut falls on the end of the prefix
    cut_at = firsts.groupBy("__class", F.col("at.cut").alias("cut")).agg(F.min("digest").alias("digest"))
    ends = holding.join(cut_at, ["__class", "cut"], "left").select(
        "__class", "cut", F.coalesce("digest", F.concat("prefix", F.lit("g"))).alias("digest")
    )
    wide = ends.groupBy("__class").agg(*[
        F.max(F.when(F.col("cut") == i, F.col("digest"))).alias(f"__cut_{i}") for i in range(len(cuts))
    ])
    high = F.lit("g")  # above every hex digit: the whole class lies before that cut
    return sizes.join(wide, "__class", "left").select(
        "__class", "__n", *[F.coalesce(f"__cut_{i}", high).alias(f"__cut_{i}") for i in range(len(cuts))]
    )


def time_split(df: DataFrame, time: str, shares: list[tuple[str, float]], *, out: str = "split") -> DataFrame:
    """Earlier rows train. Cuts are exact quantiles of the time; equal times stay together."""
    uppers = [u for _, u in shares[:-1]]
    cuts = exact_quantiles(df, {time: uppers})[time] if uppers else []
    value = ordered_number(df, time).cast("double")
    below = [(n, value <= F.lit(c)) for (n, _), c in zip(shares[:-1], cuts) if c is not None]
    return df.withColumn(out, _label(below, shares[-1][0]))


def predefined_split(df: DataFrame, column: str, names: dict[str, str] | None = None, *, out: str = "split") -> DataFrame:
    """The split is already a column; `names` renames its values."""
    value = quoted(column).cast("string")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        value = F.coalesce(F.element_at(table, value), value)
    return df.withColumn(out, value)


def split_inputs(inputs: dict[str, DataFrame], *, out: str = "split") -> DataFrame:
    """One input per split, put together as one table."""
    tagged = [df.withColumn(out, F.lit(name)) for name, df in inputs.items()]
    whole = tagged[0]
    for df in tagged[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole


def split_counts(df: DataFrame, by: list[str] | None = None, out: str = "split") -> DataFrame:
    return df.groupBy(*(by or []), out).agg(F.count(F.lit(1)).alias("row_count"))

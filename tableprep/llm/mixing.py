"""Mixing sources to target weights: subset-sum budget fitting.

A source takes whole passes over its documents as often as its target allows. For the rest of its budget, documents
are counted by exact length; most of it is spent in proportion to those counts, and bounded-knapsack dynamic
programming over the lengths that are left meets the last words. What is left to it is a few times the source's
longest text, so it always runs, whatever the lengths are. Which documents make up a length's quota is decided by a
seeded hash. Only counts by length reach one task, never documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.joins import lookup
from tableprep.llm.common import word_count
from tableprep.session import materialize

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
# What is left to the knapsack, in longest texts of the source, and how much more where that misses the budget by a word:
# a source of no more words than the last is left to it whole.
LONGEST_TEXTS = (16, 32)
PREFIX_BITS = 12
DRAW_BITS = 60
ROWS_RANKED = 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Adds `target` to a table of (source, source_size), one row per source.

    Weights repeat over the sources in order of code point, null last. Sources whose share is above `most` times
    their size stop there; what they leave is shared again by weight until none is above. The table has a row per
    source only; each round of sharing is one aggregate over it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    weighed = materialize(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)), "mix-weights")
    total, level, full = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("most")
        row = weighed.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (total - (row[0] or 0.0)) / row[1]
    return weighed.withColumn("target", F.least(F.col("weight") * level, "most")).drop("weight", "most")


def fit_quota(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near `budget` as can be without going over.

    Lengths are positive and differ; budget is less than all words together.
    """
    quota = np.zeros(len(lengths), np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return quota
    best, off = quota, budget
    few, more = LONGEST_TEXTS
    # The less is spent in proportion, the more the knapsack can choose from; small budgets are left to it whole.
    for part, texts in ((1.0, few), (0.98, few), (0.8, few), (0.0, few), (0.0, more)):
        quota, rest = _in_proportion(lengths, counts, budget, counts * (budget / whole) * part, texts * int(lengths.max()))
        quota = quota + _knapsack(lengths, counts - quota, rest)
        rest = budget - int((quota * lengths).sum())
        if rest < off:
            best, off = quota, rest
        if off == 0:
            break
    return best


def _in_proportion(lengths: np.ndarray, counts: np.ndarray, budget: int, share: np.ndarray, last: int) -> tuple[np.ndarray, int]:
    """Quotas near `share`, topped up by the largest fractions until at most `last` words of the budget are left, of which
    half are kept back. As half of `last` is more than any text, and the budget less than all, that point is met."""
    quota = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((quota * lengths).sum())
    order = np.lexsort((lengths, -(share - np.floor(share))))
    for most in (1, None):
        for i in order:
            if rest <= last:
                return quota, rest
            room = max(0, (rest - last // 2) // int(lengths[i]))
            take = min(int(counts[i] - quota[i]), room if most is None else min(most, room))
            quota[i] += take
            rest -= take * int(lengths[i])
    return quota, rest


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack with worth equal to weight: the largest sum up to `budget`.

    Copies of a length are taken in bundles of 1, 2, 4, ..., the longest texts first; each reachable sum remembers the
    bundle that first made it, so following those back uses every bundle at most once. Five bytes a word of the budget.
    """
    bundles: list[tuple[int, int]] = []
    reached = np.zeros(budget + 1, bool)
    by = np.full(budget + 1, -1, np.int32)
    reached[0], top = True, 0
    for i in np.flatnonzero((counts > 0) & (lengths <= budget))[::-1]:
        left, size = min(int(counts[i]), budget // int(lengths[i])), 1
        while left > 0 and not reached[budget]:
            size = min(size, left)
            step = size * int(lengths[i])
            if step <= budget:
                end = min(top, budget - step) + 1  # no sum above `top` is reached so far
                new = np.flatnonzero(reached[:end] & ~reached[step : step + end]) + step
                if len(new):
                    reached[new] = True
                    by[new] = len(bundles)
                    bundles.append((int(i), size))
                    top = max(top, int(new[-1]))
            left -= size
            size *= 2
    out = np.zeros(len(lengths), np.int64)
    at = top
    while at > 0:
        i, size = bundles[by[at]]
        out[i] += size
        at -= size * int(lengths[i])
    return out


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Passes and quota of one source from its counts by length (at most the root of twice its words, many rows)."""
    group = group.sort_values("size", ignore_index=True)
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    whole, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
    passes = min(MOST_PASSES, int(target // whole)) if whole else 0
    budget = 0 if passes == MOST_PASSES else round(target - passes * whole)
    quota = counts if budget >= whole else fit_quota(lengths, counts, budget)
    return pd.DataFrame({"source_key": group["source_key"], "size": lengths, "n": counts, "passes": passes, "quota": quota})


def _cuts(rows: DataFrame) -> DataFrame:
    """Where the quota of each (source, size) ends in the order of draws: prefix, and rows still to take of it.

    Prefixes of the draws are counted, first short ones, then longer ones inside the prefix in which the quota ends,
    until that holds few rows. Nothing larger than a prefix's counts is ranked.
    """
    key = ["source_key", "size"]
    largest = rows.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(1, largest / ROWS_RANKED)) / PREFIX_BITS))
    levels = min(levels, DRAW_BITS // PREFIX_BITS)
    cut, inside = None, rows.withColumn("need", F.col("quota"))
    for level in range(1, levels + 1):
        prefix = F.shiftright("draw", DRAW_BITS - PREFIX_BITS * level)
        counted = inside.groupBy(*key, "n", "need", prefix.alias("cut")).agg(F.count("*").alias("rows"))
        before = F.sum("rows").over(Window.partitionBy(*key).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
        counted = counted.withColumn("before", F.coalesce(before, F.lit(0)))
        cut = counted.where("before < need AND need <= before + rows").select(*key, "n", "cut", (F.col("need") - F.col("before")).alias("need"))
        cut = materialize(cut, "mix-cuts")
        if level < levels:
            inside = _with_cuts(rows, cut).where(prefix == F.col("cut")).drop("cut")
    return cut.withColumn("shift", F.lit(DRAW_BITS - PREFIX_BITS * levels))


def _with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Each row with what is said of its (source, size): broadcast where that is small, else one shuffle in which hot
    lengths are spread over salts."""
    return lookup(rows, cut.withColumnRenamed("n", "weight"), ["source_key", "size"], weight="weight")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42
) -> DataFrame:
    """How many words the mix takes from every row: id, source, size, source_size, target, taken, row_hash.

    Words are runs of anything but ASCII white space; null texts have none and are never taken. A null source is a
    source of its own. Rows that repeat an id draw alike, and the quota still holds; which of such equal rows is
    taken is open. An empty table gives an empty result.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 64 - DRAW_BITS)
    source = F.col(source_col).cast("string")
    sizes = docs.select(
        F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
        word_count(F.col(text_col)).alias("size"), draw.alias("draw"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"),
    )
    sizes = materialize(sizes, "mix-sizes")
    counted = materialize(sizes.groupBy("source", "source_key", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sources = counted.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    shares = materialize(targets(sources).drop("source"), "mix-targets")
    lengths = lookup(counted.where("size > 0"), shares, ["source_key"], weight="source_rows").select("source_key", "size", "n", "target")
    plan = lengths.groupBy("source_key").applyInPandas(_plan, "source_key string, size long, n long, passes int, quota long")
    rows = lookup(sizes, plan.withColumn("weight", F.col("n")), ["source_key", "size"], weight="weight")
    rows = materialize(rows.na.fill(0, ["passes", "quota", "n"]), "mix-rows")
    some = rows.where("quota > 0 AND quota < n")
    met = _with_cuts(some, _cuts(some)).withColumn("prefix", F.expr("shiftright(draw, shift)"))
    at_cut = met.where("prefix = cut")
    rank = F.row_number().over(Window.partitionBy("source_key", "size", "prefix").orderBy("draw", "id", "row_hash"))
    chosen = at_cut.withColumn("extra", (rank <= F.col("need")).cast("int")).unionByName(
        met.where("prefix <> cut").withColumn("extra", (F.col("prefix") < F.col("cut")).cast("int"))
    )
    rest = rows.where("NOT (quota > 0 AND quota < n)").withColumn("extra", (F.col("quota") > 0).cast("int"))
    columns = ["id", "source", "source_key", "size", "row_hash", "passes", "extra"]
    both = chosen.select(columns).unionByName(rest.select(columns))
    return lookup(both, shares, ["source_key"], weight="source_rows").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("size") * (F.col("passes") + F.col("extra"))).cast("long").alias("taken"),
        (F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0)).cast("int").alias("times"), "row_hash",
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns."""
    times = mix(docs, id_col, text_col, source_col, seed).where("times > 0")
    # Rows that repeat id and text share what they take, so they are looked up once.
    times = times.groupBy(F.col(id_col).alias("__id"), F.col("row_hash").alias("__hash"), F.col("source").alias("__source")).agg(F.sum("times").alias("__times"), F.count("*").alias("__n"))
    times = materialize(times, "mix-times")
    mine = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (mine == F.col("__hash")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    mixed = docs.join(times.where("__n = 1").hint("merge"), same).select(*own, repeat.alias("__copy")).drop("__copy")
    if times.where("__n > 1").isEmpty():
        return mixed
    several = docs.join(times.where("__n > 1").hint("merge"), same).dropDuplicates(["__id", "__hash", "__source"])
    return mixed.unionByName(several.select(*own, repeat.alias("__copy")).drop("__copy"))

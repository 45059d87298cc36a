"""Most frequent values without shuffling every value: bounded counters per task, then one verifying count.

Each task keeps Misra-Gries counters of the values' hashes and says by how much they may fall short. Summed over the
tasks this bounds the count of any value, counted or not, so the values that can be among the most frequent are known
before anything is shuffled, and a second scan counts just these. Where the bound cannot tell (a column whose values
hardly repeat), the column is counted in full; so results are exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep import fixed_values as fixed
from tableprep.functions.columns import comparable, ratio, type_class, value_text
from tableprep.functions.joins import is_small
from tableprep.operators.profile import top_values
from tableprep.session import materialize

COUNTERS = 4096
SUMMARY_SCHEMA = "position int, hash long, low long, lost long"


class Counters:
    """Misra-Gries counters: a count falls short of the truth by `lost` at most, and `lost` is at most rows / (most + 1)."""

    def __init__(self, most: int):
        self.most, self.rows, self.lost = most, 0, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.rows += len(values)
        fresh, times = np.unique(values, return_counts=True)
        keys, place = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate([self.counts, times]))
        if len(keys) > self.most:
            cut = np.partition(counts, -self.most - 1)[-self.most - 1]
            self.lost += int(cut)
            counts = counts - cut
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


def counter_summaries(df: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(position, hash, low, lost): every task's counters by column, and a row without hash with the rows and the loss."""
    hashes = [F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{i}") for i, v in enumerate(comparable(df, c) for c in df.columns)]
    width = len(hashes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Counters(counters) for _ in range(width)]
        for batch in batches:
            for own, column in zip(kept, batch.columns):
                own.add(pc.drop_null(column).to_numpy(zero_copy_only=False))
        for i, own in enumerate(kept):
            hashed = pa.concat_arrays([pa.array(own.keys), pa.nulls(1, pa.int64())])
            low, lost = np.append(own.counts, own.rows), np.append(np.zeros(len(own.counts), np.int64), own.lost)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), i, np.int32)), hashed, pa.array(low), pa.array(lost)], ["position", "hash", "low", "lost"])

    return df.select(hashes).mapInArrow(counted, SUMMARY_SCHEMA)


def heavy_values(df: DataFrame, k: int = fixed.MAX_TOP_VALUES, *, counters: int = COUNTERS) -> DataFrame:
    """(name, rank, value, count, rate) of the k most frequent values of every column, ties by value: the same rows as
    `top_values`, which counts every value. `counters` bounds what a task keeps of a column and changes no result."""
    summaries = materialize(counter_summaries(df, counters), "counters")
    sums = summaries.groupBy("position", "hash").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost"))
    bounds = {r["position"]: (r["low"], r["lost"]) for r in sums.where("hash IS NULL").collect()}  # one row a column
    place = F.row_number().over(Window.partitionBy("position").orderBy(F.col("low").desc()))
    kth = sums.where("hash IS NOT NULL").withColumn("place", place).where(F.col("place") == k)
    least = {r["position"]: r["low"] for r in kth.select("position", "low").collect()}
    # nothing uncounted can reach the k-th largest count if that is above all that was lost
    settled = [i for i, (_, lost) in bounds.items() if lost == 0 or lost < least.get(i, 0)]
    pieces = []
    if settled:
        reach = {i: least.get(i, 0) - bounds[i][1] for i in settled}
        wanted = sums.where(F.col("hash").isNotNull() & (F.col("low") >= _by_position(reach)))
        ranked = materialize(_verified(df, settled, materialize(wanted.select("position", "hash"), "candidates"), k), "heavy")
        # equal hashes can only raise what counters say; then the k-th count falls short of what was asked of candidates
        last = {r["position"]: r["n"] for r in ranked.where(F.col("rank") == k).select("position", "n").collect()}
        settled = [i for i in settled if last.get(i, 0) >= least.get(i, 0)]
        names = F.array(*[F.lit(c) for c in df.columns])
        total = _by_position({i: bounds[i][0] for i in settled} or {-1: 0})
        pieces.append(ranked.where(F.col("position").isin(settled)).select(
            F.get(names, F.col("position")).alias("name"), F.col("rank").cast("bigint").alias("rank"), "value",
            F.col("n").alias("count"), ratio(F.col("n"), total).alias("rate"),
        ))
    rest = [c for i, c in enumerate(df.columns) if i not in settled]
    if rest:
        pieces.append(top_values(df.select([F.col(f"`{c}`") for c in rest]), k))
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def _by_position(values: dict[int, int]) -> Column:
    pairs = [F.lit(x) for i, v in values.items() for x in (i, int(v))]
    return F.element_at(F.create_map(*pairs), F.col("position"))


def _verified(df: DataFrame, positions: list[int], candidates: DataFrame, k: int) -> DataFrame:
    """(position, rank, value, n): the k candidates with the largest exact counts. Values of a type are told apart and put
    in order as that type, texts by a second hash, so that a text is carried once a task."""
    side = F.broadcast(candidates) if is_small(candidates) else candidates.hint("merge")
    kinds = {i: df.schema.fields[i].dataType for i in positions}
    out = None
    for name in sorted({t.simpleString() for t in kinds.values()}):
        mine = [i for i, t in kinds.items() if t.simpleString() == name]
        cells = [F.struct(F.lit(i).alias("position"), comparable(df, df.columns[i]).alias("value")) for i in mine]
        rows = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).withColumn("hash", F.xxhash64("value"))
        found = rows.join(side, ["position", "hash"], "left_semi")
        counted = found.groupBy("position", "hash", F.xxhash64(F.lit("second"), F.col("value")).alias("other")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.partitionBy("position").orderBy(F.col("n").desc(), "value"))
        data_type = kinds[mine[0]]
        shown = F.col("value") if type_class(data_type) in ("string", "object") else value_text(F.col("value"), data_type)
        best = counted.withColumn("rank", rank).where(F.col("rank") <= k).select("position", "rank", shown.alias("value"), "n")
        out = best if out is None else out.unionByName(best)
    return out

"""Samples in an order of the user's own: the first distinct values of every column along an order column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep import fixed_values as fixed
from tableprep.functions.columns import TEMPORAL, present, quoted, type_class, value_text
from tableprep.functions.quantiles import ordered_number

PLACE = "__place"
LOOKED_AT = 64  # rows whose values are looked at together


def ordered_samples(df: DataFrame, order: str, k: int = fixed.MAX_SAMPLE_VALUES, *, columns: list[str] | None = None) -> DataFrame:
    """(name, rank, value): per column the k distinct values that come first along `order`, in that order.

    A value comes where its earliest row is; values that come at one place go by their text. Rows without an order come
    last. A task hands on k values a column at most: a value among the first k of all is among the first k of the task
    that has its earliest row, so nothing else need be shuffled.
    """
    columns = columns or [c for c in df.columns if c != order]
    kind = df.schema[order].dataType
    ordinal = isinstance(kind, TEMPORAL) or type_class(kind) in ("integer", "float", "numeric", "boolean")
    place = ordered_number(df, order).cast("decimal(38,10)" if isinstance(kind, T.DecimalType) else "double" if type_class(kind) == "float" else "long") if ordinal else quoted(order).cast("string")
    texts = [value_text(present(df, c), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(place.alias(PLACE), *texts)
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField(PLACE, rows.schema[PLACE].dataType)])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for i in range(len(columns)):
                own = pa.table({"value": batch.column(f"c{i}"), PLACE: batch.column(PLACE)})
                own = own.filter(pc.is_valid(own["value"]))
                best[i] = _first(pa.concat_tables([best[i], own]) if i in best else own, k)
        for i, own in best.items():
            position = pa.array([i] * own.num_rows, pa.int32())
            yield from pa.table({"position": position, "value": own["value"], PLACE: own[PLACE]}).combine_chunks().to_batches()

    found = rows.mapInArrow(firsts, schema).groupBy("position", "value").agg(F.min(PLACE).alias(PLACE))
    rank = F.row_number().over(Window.partitionBy("position").orderBy(F.col(PLACE).asc_nulls_last(), "value"))
    names = F.array(*[F.lit(c) for c in columns])
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.get(names, F.col("position")).alias("name"), F.col("rank").cast("bigint").alias("rank"), "value"
    )


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The first row of each of the k distinct values that come first. Texts stay in Arrow; few become Python's at a time."""
    order = pc.sort_indices(rows, sort_keys=[(PLACE, "ascending"), ("value", "ascending")], null_placement="at_end")
    seen: set[str] = set()
    kept: list[int] = []
    for start in range(0, len(order), LOOKED_AT):
        some = order.slice(start, LOOKED_AT)
        for at, value in zip(some.to_pylist(), rows["value"].take(some).to_pylist()):
            if value not in seen:
                seen.add(value)
                kept.append(at)
                if len(kept) == k:
                    return rows.take(pa.array(kept, pa.int64()))
    return rows.take(pa.array(kept, pa.int64()))

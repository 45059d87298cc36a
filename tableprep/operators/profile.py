"""Table and column profiles.

One fused aggregate gives counts and numeric and time ranges. A second pass counts distinct
values: columns of one data type are unfolded to (position, value) rows and grouped, with partial
aggregation before the shuffle, and that table yields the distinct counts, the top values, the
samples and the datetime test. Long texts are grouped by a 128-bit fingerprint and a prefix, so
that whole documents are never shuffled; only those that may be reported are fetched again. Order
and ties always go by whole values.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep import fixed_values as fixed
from tableprep.functions.columns import (
    TEMPORAL,
    comparable,
    finite,
    iso_text,
    number,
    present,
    ratio,
    type_class,
    value_text,
)
from tableprep.functions.datetimes import DATETIME_FORMATS, LONGEST, parse_with
from tableprep.functions.hashing import row_fingerprint, value_fingerprint
from tableprep.functions.joins import is_small
from tableprep.functions.quantiles import exact_quantiles
from tableprep.session import materialize

PREFIX = 64
TEXT = "text"
COLUMN_BATCH = 50
CONCURRENT_TABLES = 8
SUMMARY_CLASSES = ("boolean", "integer", "float", "numeric")


class Family(NamedTuple):
    """Value counts of the columns of one data type, at these positions of the table."""

    key: str
    counts: DataFrame
    positions: list[int]


def table_profile(
    df: DataFrame,
    dataset_name: str = "dataframe",
    *,
    max_columns: int | None = None,
    source_type: str = "dataframe",
) -> DataFrame:
    """One row: shape, the columns left out by the cap, and the duplicate rows over all columns."""
    kept, cut = _capped(df, max_columns)
    copies = df.select(*[c.alias(f"h{i}") for i, c in enumerate(row_fingerprint(df))])
    counted = copies.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(source_type).alias("source_type"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(kept)).alias("profiled_columns"),
        F.array(*[F.lit(c) for c in cut]).cast("array<string>").alias("truncated_columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def column_profile(
    df: DataFrame,
    dataset_name: str = "dataframe",
    *,
    max_sample_values: int = fixed.MAX_SAMPLE_VALUES,
    max_top_values: int = fixed.MAX_TOP_VALUES,
    max_columns: int | None = None,
    include_value_counts: bool = True,
    median: str = "exact",
) -> DataFrame:
    """One row per column, in table order. `median` is exact, approx or none."""
    kept, _ = _capped(df, max_columns)
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    summary = column_summary(df, dataset_name, median=median)
    families = value_counts(df)
    # count_if over n keeps n in every branch, so that all of them reuse one shuffle
    distinct = F.count_if(F.col("n") > 0).alias("unique_count")
    parts = [_union([f.counts.groupBy("position").agg(distinct) for f in families])]
    if max_sample_values > 0:
        parts.append(_listed(df, families, max_sample_values, by_count=False))
    if include_value_counts and max_top_values > 0:
        parts.append(_listed(df, families, max_top_values, by_count=True))
    texts = [f.counts for f in families if f.key == TEXT]
    if texts:
        parts.append(_union([_datetime_texts(c) for c in texts]))
    out = reduce(lambda a, b: a.join(F.broadcast(b), "position", "left"), parts, summary)
    return _finish(df, out)


def quick_profile(df: DataFrame, dataset_name: str = "dataframe") -> DataFrame:
    """One scan and no shuffle of values: distinct counts (HyperLogLog) and medians are approximate,
    samples and top values are left out. For a first look at very large tables."""
    return _finish(df, column_summary(df, dataset_name, median="approx", distinct="approx"))


def column_summary(df: DataFrame, dataset_name: str, *, median: str = "exact", distinct: str = "later") -> DataFrame:
    """Counts, missing counts, numeric and time ranges of every column from one scan."""
    fields = df.schema.fields
    numeric = [f.name for f in fields if type_class(f.dataType) in SUMMARY_CLASSES]
    medians = (
        exact_quantiles(df, {n: [0.5] for n in numeric}) if median == "exact" else {}
    )
    aggregates: list[Column] = []
    structs: list[Column] = []
    missing = F.lit(None).cast("double")
    for i, f in enumerate(fields):
        value = present(df, f.name)
        aggregates.append(F.count(value).alias(f"n{i}"))
        found = []
        if distinct == "approx":
            aggregates.append(F.approx_count_distinct(comparable(df, f.name)).alias(f"u{i}"))
            found = [F.least(F.col(f"u{i}"), F.col(f"n{i}")).alias("unique_count")]
        low = high = mean = middle = std = missing
        first = last = F.lit(None).cast("string")
        if f.name in numeric:
            x = number(value, f.dataType)
            aggregates += [
                F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"av{i}"),
                F.stddev_samp(x).alias(f"sd{i}"),
            ]
            low, high, mean = (finite(F.col(f"{a}{i}")) for a in ("lo", "hi", "av"))
            std = F.when(F.col(f"n{i}") == 1, F.lit(0.0)).otherwise(finite(F.nanvl(F.col(f"sd{i}"), missing)))
            if median == "exact":
                middle = finite(F.lit(medians[f.name][0]).cast("double"))
            elif median == "approx":
                aggregates.append(F.percentile_approx(x, 0.5).alias(f"md{i}"))
                middle = finite(F.col(f"md{i}"))
        if isinstance(f.dataType, TEMPORAL):
            aggregates += [F.min(value).alias(f"t0{i}"), F.max(value).alias(f"t1{i}")]
            first, last = iso_text(F.col(f"t0{i}")), iso_text(F.col(f"t1{i}"))
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(type_class(f.dataType)).alias("type_class"),
                F.col("row_count"),
                F.col(f"n{i}").alias("non_null_count"),
                low.alias("num_min"), high.alias("num_max"), mean.alias("num_mean"),
                middle.alias("num_median"), std.alias("num_std"),
                first.alias("time_min"), last.alias("time_max"), *found,
            )
        )
    row = df.agg(F.count(F.lit(1)).alias("row_count"), *aggregates)
    return row.select(F.inline(F.array(*structs))).withColumn("dataset_name", F.lit(dataset_name))


def value_counts(df: DataFrame) -> list[Family]:
    """Per data type a table with the count n of every distinct value of every column.

    Text and nested columns have (position, is_text, head, h0, h1, padded, n); all others
    (position, value, n). Wide tables are unfolded in batches.
    """
    families: dict[str, list[int]] = {}
    for i, f in enumerate(df.schema.fields):
        key = TEXT if type_class(f.dataType) in ("string", "object") else f.dataType.simpleString()
        families.setdefault(key, []).append(i)
    pieces = []
    for key, positions in families.items():
        for start in range(0, len(positions), COLUMN_BATCH):
            batch = positions[start : start + COLUMN_BATCH]
            # Counts of texts are written, as their candidates are looked at before the rest is planned.
            grouped = materialize(_text_counts(df, batch), "text-counts") if key == TEXT else _typed_counts(df, batch)
            pieces.append(Family(key, grouped, batch))
    return pieces


def _unfolded(df: DataFrame, positions: list[int]) -> DataFrame:
    fields = df.schema.fields
    pairs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(type_class(fields[i].dataType) == "string").alias("is_text"),
            comparable(df, fields[i].name).alias("value"),
        )
        for i in positions
    ]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def _typed_counts(df: DataFrame, positions: list[int]) -> DataFrame:
    return _unfolded(df, positions).groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))


def _text_counts(df: DataFrame, positions: list[int]) -> DataFrame:
    long = F.length("value") > PREFIX
    h0, h1 = value_fingerprint(F.col("value"))
    trimmed = F.trim("value")  # a date between many blanks is a date
    keyed = _unfolded(df, positions).select(
        "position", "is_text", F.substring("value", 1, PREFIX).alias("head"),
        F.when(long, h0).alias("h0"), F.when(long, h1).alias("h1"),
        F.when(long & (F.length(trimmed) <= LONGEST), trimmed).alias("padded"),
    )
    return keyed.groupBy("position", "is_text", "head", "h0", "h1", "padded").agg(F.count(F.lit(1)).alias("n"))


def ranked_values(df: DataFrame, family: Family, k: int, *, by_count: bool) -> DataFrame:
    """(position, rank, value, n): the k most frequent, or k smallest, values. Ties go by value."""
    _limit_windows(df, k)
    counts = family.counts
    if family.key != TEXT:
        order = [F.col("n").desc(), F.col("value")] if by_count else [F.col("value")]
        rank = F.row_number().over(Window.partitionBy("position").orderBy(*order))
        picked = counts.withColumn("rank", rank).where(F.col("rank") <= k)
        data_type = counts.schema["value"].dataType
        return picked.select("position", "rank", value_text(F.col("value"), data_type).alias("value"), "n")
    if by_count:
        # All that share the last count and prefix are candidates; whole values decide among them.
        head = F.rank().over(Window.partitionBy("position").orderBy(F.col("n").desc(), "head"))
        found = whole_values(df, counts.withColumn("place", head).where(F.col("place") <= k), family.positions)
        order = [F.col("n").desc(), F.col("value")]
    else:
        # A short text is its own head, so counts tell the smallest; texts are read again only where long ones are near.
        place = F.rank().over(Window.partitionBy("position").orderBy("head"))
        near = counts.withColumn("place", place).where(F.col("place") <= k)
        long_near = [r["position"] for r in near.where(F.col("h0").isNotNull()).select("position").distinct().collect()]
        found = near.where(~F.col("position").isin(long_near)).select("position", F.col("head").alias("value"), "n")
        if long_near:
            found = found.unionByName(_smallest_counted(df, counts, long_near, k))
        order = [F.col("value")]
    rank = F.row_number().over(Window.partitionBy("position").orderBy(*order))
    return found.select("position", rank.alias("rank"), "value", "n").where(F.col("rank") <= k)


def _smallest_counted(df: DataFrame, counts: DataFrame, positions: list[int], k: int) -> DataFrame:
    """(position, value, n) of the k smallest whole texts of each column, with their counts."""
    h0, h1 = value_fingerprint(F.col("value"))
    long = F.length("value") > PREFIX
    keyed = smallest_texts(df, positions, k).select(
        F.col("position").alias("at"), "value", F.substring("value", 1, PREFIX).alias("start"),
        F.when(long, h0).alias("f0"), F.when(long, h1).alias("f1"),
    )
    same = (F.col("position") == F.col("at")) & (F.col("head") == F.col("start")) & F.col("h0").eqNullSafe(F.col("f0")) & F.col("h1").eqNullSafe(F.col("f1"))
    return counts.join(F.broadcast(keyed), same).select("position", "value", "n")


def _limit_windows(df: DataFrame, k: int) -> None:
    """Let Spark cut the ranks of a window per task for any k that is asked for."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    conf = df.sparkSession.conf
    if int(conf.get(name)) < k:
        conf.set(name, str(k))


def smallest_texts(df: DataFrame, positions: list[int], k: int) -> DataFrame:
    """(position, value): the k smallest distinct whole texts of each column. A task hands on k of each at most."""
    names = {f"c{i}": i for i in positions}

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[str]] = {i: [] for i in names.values()}
        for batch in batches:
            for column, i in zip(batch.columns, names.values()):
                values = pc.drop_null(column)
                if len(best[i]) == k and len(values):
                    values = values.filter(pc.less(values, pa.scalar(best[i][-1], values.type)))
                if len(values):
                    best[i] = heapq.nsmallest(k, {*best[i], *pc.unique(values).to_pylist()})
        rows = [(i, v) for i, found in best.items() for v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["position", "value"])

    fields = df.schema.fields
    texts = df.select(*[comparable(df, fields[i].name).cast("string").alias(c) for c, i in names.items()])
    found = texts.mapInArrow(smallest, "position int, value string").distinct()
    rank = F.row_number().over(Window.partitionBy("position").orderBy("value"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def whole_values(df: DataFrame, picked: DataFrame, positions: list[int]) -> DataFrame:
    """Adds `value`: the text itself, fetched where `head` is but its prefix."""
    picked = materialize(picked, "picked-values")
    wanted = picked.where(F.col("h0").isNotNull()).select("position", "h0", "h1")
    if wanted.isEmpty():
        return picked.withColumn("value", F.col("head"))
    # Mostly k rows a column; many only where long texts share both their count and their prefix.
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted.hint("merge")
    h0, h1 = value_fingerprint(F.col("value"))
    rows = _unfolded(df, positions).where(F.length("value") > PREFIX)
    found = (
        rows.select("position", "value", h0.alias("h0"), h1.alias("h1"))
        .join(wanted, ["position", "h0", "h1"], "left_semi")
        .groupBy("position", "h0", "h1")
        .agg(F.min("value").alias("whole"))
    )
    return picked.join(found, ["position", "h0", "h1"], "left").withColumn("value", F.coalesce("whole", "head")).drop("whole")


def top_values(df: DataFrame, k: int = fixed.MAX_TOP_VALUES) -> DataFrame:
    """(name, rank, value, count, rate) of the k most frequent values of every column."""
    return _ranked_rows(df, k, by_count=True)


def sample_values(df: DataFrame, k: int = fixed.MAX_SAMPLE_VALUES) -> DataFrame:
    """(name, rank, value, count, rate) of the k smallest distinct values of every column."""
    return _ranked_rows(df, k, by_count=False)


def _ranked_rows(df: DataFrame, k: int, *, by_count: bool) -> DataFrame:
    families = value_counts(df)
    rows = _union([ranked_values(df, f, k, by_count=by_count) for f in families])
    totals = _union([f.counts.groupBy("position").agg(F.sum("n").alias("total")) for f in families])
    names = F.array(*[F.lit(c) for c in df.columns])
    return rows.join(F.broadcast(totals), "position").select(
        F.get(names, F.col("position")).alias("name"), F.col("rank").cast("bigint").alias("rank"),
        "value", F.col("n").alias("count"), ratio(F.col("n"), F.col("total")).alias("rate"),
    )


def _listed(df: DataFrame, families: list, k: int, *, by_count: bool) -> DataFrame:
    rows = _union([ranked_values(df, f, k, by_count=by_count) for f in families])
    entry = F.struct("rank", "value", "n")
    listed = rows.groupBy("position").agg(F.sort_array(F.collect_list(entry)).alias("listed"))
    if by_count:
        return listed.select("position", F.col("listed").alias("top_listed"))
    return listed.select("position", F.transform("listed", lambda e: e["value"]).alias("sample_values"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _datetime_texts(counts: DataFrame) -> DataFrame:
    """Per text column the format most values parse by, kept when enough of them do."""
    formats = range(len(DATETIME_FORMATS))
    text = F.when(F.col("is_text"), F.when(F.col("h0").isNull(), F.col("head")).otherwise(F.col("padded")))
    stamps = counts.select(
        "position", "n",
        *[parse_with(text, j).alias(f"s{j}") for j in formats],
    )
    per_format = stamps.groupBy("position").agg(
        F.sum("n").alias("total"),
        *[a for j in formats for a in (
            F.sum(F.when(F.col(f"s{j}").isNotNull(), F.col("n")).otherwise(0)).alias(f"c{j}"),
            F.min(f"s{j}").alias(f"a{j}"), F.max(f"s{j}").alias(f"z{j}"),
        )],
    )
    options = F.array(*[
        F.struct(
            F.col(f"c{j}").alias("hits"), F.lit(-j).alias("preference"),
            F.lit(DATETIME_FORMATS[j][0]).alias("format"),
            F.col(f"a{j}").alias("first"), F.col(f"z{j}").alias("last"),
        )
        for j in formats
    ])
    best = per_format.where(F.col("total") > 0).select("position", "total", F.array_max(options).alias("best"))
    return best.where(F.col("best.hits") >= F.col("total") * fixed.DATETIME_PARSE_RATE).select(
        "position", F.col("best.format").alias("datetime_format"),
        iso_text(F.col("best.first")).alias("text_min"), iso_text(F.col("best.last")).alias("text_max"),
    )


def _finish(df: DataFrame, out: DataFrame) -> DataFrame:
    def has(name: str, data_type: str) -> Column:
        return F.col(name) if name in out.columns else F.lit(None).cast(data_type)

    non_null = F.col("non_null_count")
    unique = F.coalesce("unique_count", F.lit(0))
    tops = F.transform(
        has("top_listed", "array<struct<rank:int,value:string,n:bigint>>"),
        lambda e: F.struct(e["value"].alias("value"), e["n"].alias("count"), ratio(e["n"], non_null).alias("rate")),
    )
    is_time = F.col("type_class") == "datetime"
    detected = has("datetime_format", "string").isNotNull()
    return out.select(
        "dataset_name", "position", "name", "dtype", "type_class", "row_count", "non_null_count",
        (F.col("row_count") - non_null).alias("missing_count"),
        ratio(F.col("row_count") - non_null, F.col("row_count")).alias("missing_rate"),
        unique.alias("unique_count"),
        ratio(unique, non_null).alias("unique_rate"),
        F.coalesce(has("sample_values", "array<string>"), F.array().cast("array<string>")).alias("sample_values"),
        F.coalesce(tops, F.array().cast("array<struct<value:string,count:bigint,rate:double>>")).alias("top_values"),
        "num_min", "num_max", "num_mean", "num_median", "num_std",
        (is_time | detected).alias("has_datetime_summary"),
        has("datetime_format", "string").alias("datetime_format"),
        F.coalesce(F.col("time_min"), has("text_min", "string")).alias("datetime_min"),
        F.coalesce(F.col("time_max"), has("text_max", "string")).alias("datetime_max"),
    ).orderBy("position")


def catalog_profile(tables: dict[str, DataFrame], **options) -> DataFrame:
    """The column profiles of many tables as one result keyed by dataset_name.

    The small jobs that find medians run side by side.
    """
    with ThreadPoolExecutor(CONCURRENT_TABLES) as pool:
        return _union(list(pool.map(lambda t: column_profile(t[1], t[0], **options), tables.items())))


def catalog_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    """The table profiles of many tables as one result."""
    return _union([table_profile(df, name, **options) for name, df in tables.items()])


def profile_document(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One JSON text per column, ready to append to a report; nulls stay visible as null."""
    joined = columns.join(F.broadcast(tables.select("dataset_name", "duplicate_row_count")), "dataset_name")
    body = F.to_json(F.struct(*[F.col(c) for c in joined.columns]), {"ignoreNullFields": "false"})
    return joined.select("dataset_name", "name", body.alias("document"))


def _capped(df: DataFrame, max_columns: int | None) -> tuple[list[str], list[str]]:
    names: Iterable[str] = df.columns
    names = list(names)
    if max_columns is None or len(names) <= max_columns:
        return names, []
    return names[:max_columns], names[max_columns:]

"""Categorical encodings. Category maps are tables, looked up by a checked broadcast or a split join."""

from __future__ import annotations

from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.functions.columns import fresh_name, quoted
from tableprep.functions.hashing import draw, fast_bucket, text_bucket
from tableprep.functions.joins import BROADCAST_ROWS, is_small, lookup
from tableprep.operators.fitted import Fitted, StepData, Transform, fact, make, step_kind
from tableprep.operators.fitting import Answers, Fit, count_cells, fit_together
from tableprep.session import materialize

ONE_HOT_COLUMNS = 1000


def category_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Per column a written (category, n) table of its non-null values as text, all from one scan."""
    counted = count_cells(df, [quoted(c).cast("string") for c in columns])
    return {c: counted.where(F.col("part") == i).drop("part") for i, c in enumerate(columns)}


def _by_text(rows: DataFrame, table: DataFrame, column: str, value: str) -> tuple[DataFrame, str]:
    """Look the column's text up in a table keyed by category: rows with its `value`, under a name they don't use."""
    name = fresh_name(rows.columns, value)
    side = table.select("category", "n", F.col(value).alias(name))
    return lookup(rows, side, {"category": quoted(column).cast("string")}, weight="n"), name


def _unseen(known: Column, handle_unknown: str, column: str, default: Column) -> Column:
    if handle_unknown == "error":
        missing = quoted(column).isNotNull() & known.isNull()
        return F.when(missing, F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), quoted(column).cast("string")))).otherwise(F.coalesce(known, default))
    return F.coalesce(known, default)


def one_hot_fit(column: str, *, handle_unknown: str = "ignore", output: str = "columns", limit: int = ONE_HOT_COLUMNS) -> Fit:
    """`columns`: a 0/1 column per category; `vector`: one sparse vector column. The form is the caller's choice at
    every size; more categories than `limit` cannot be columns, which is an error.

    Values not seen when fitting become all zeros.
    """
    if output not in ("columns", "vector"):
        raise ValueError(f"one_hot output is columns or vector, not {output}")
    params = {"column": column, "handle_unknown": handle_unknown}

    def as_columns(found: Answers) -> Fitted:
        categories = found.categories[column]
        if categories is None:
            raise ValueError(f"{column} has more than {limit} categories: ask for output vector")
        facts = [fact(column, "one_hot", "category", c) for c in categories]
        return make("one_hot", {**params, "categories": categories}, facts=facts, outputs={column: [f"{column}_{c}" for c in categories]})

    def as_vector(found: Answers) -> Fitted:
        index = category_index(found.counts[column])
        size = index.count()
        facts, outputs = [fact(column, "one_hot", "categories", size)], {column: [f"{column}_vector"]}
        return make("one_hot_vector", {**params, "size": size}, facts=facts, outputs=outputs, tables={"index": index})

    if output == "vector":
        return Fit([column], [column], as_vector, counted=[column])
    return Fit([column], [column], as_columns, listed={column: limit})


@step_kind("one_hot")
def _flags(data: StepData) -> Transform:
    column, categories = data.params["column"], data.params["categories"]
    names = [f"{column}_{c}" for c in categories]

    def apply(rows: DataFrame) -> DataFrame:
        if clash := set(names) & set(rows.columns):
            raise ValueError(f"one-hot columns exist already: {sorted(clash)}")
        value = quoted(column).cast("string")
        if data.params["handle_unknown"] == "error":
            known = F.when(value.isin(*categories), value)
            value = _unseen(known, "error", column, F.lit(None))
        flags = {n: F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for n, c in zip(names, categories)}
        return rows.withColumns(flags).drop(column)

    return apply


@step_kind("one_hot_vector")
def _flag_vector(data: StepData) -> Transform:
    column, size, index = data.params["column"], data.params["size"], data.tables["index"]

    def apply(rows: DataFrame) -> DataFrame:
        found, name = _by_text(rows, index, column, "category_index")
        spot = _unseen(quoted(name), data.params["handle_unknown"], column, F.lit(size))
        placed = found.withColumn(name, spot.cast("double"))
        encoder = OneHotEncoder(inputCol=name, outputCol=f"{column}_vector", dropLast=True)
        width = rows.sparkSession.range(size, size + 1).select(F.col("id").cast("double").alias(name))
        return encoder.fit(width).transform(placed).drop(name, column)

    return apply


def fit_one_hot(df: DataFrame, column: str, **options: Any) -> Fitted:
    return fit_together(df, [one_hot_fit(column, **options)])[0]


def category_index(counts: DataFrame) -> DataFrame:
    """Number the categories 0.. in sorted order.

    Few categories are numbered by one window. Many are sorted by range, written with their
    partition number, and numbered per partition on top of the sizes of the partitions before.
    """
    if is_small(counts, BROADCAST_ROWS):
        ranked = Window.partitionBy(F.lit(0)).orderBy("category")
        return counts.withColumn("category_index", (F.row_number().over(ranked) - 1).cast("bigint"))
    ordered = materialize(counts.orderBy("category").withColumn("part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("category")
    return ordered.join(F.broadcast(offsets), "part").select(
        "category", "n", (F.col("offset") + F.row_number().over(within) - 1).alias("category_index")
    )


def ordinal_fit(column: str, *, handle_unknown: str = "ignore") -> Fit:
    """Position among the sorted categories; −1 for unseen and missing values."""

    def build(found: Answers) -> Fitted:
        params = {"column": column, "handle_unknown": handle_unknown}
        tables = {"index": category_index(found.counts[column])}
        return make("ordinal", params, facts=[fact(column, "ordinal", "unseen", -1)], outputs={column: [column]}, tables=tables)

    return Fit([column], [column], build, counted=[column])


@step_kind("ordinal")
def _positions(data: StepData) -> Transform:
    column = data.params["column"]

    def apply(rows: DataFrame) -> DataFrame:
        found, name = _by_text(rows, data.tables["index"], column, "category_index")
        number = _unseen(quoted(name), data.params["handle_unknown"], column, F.lit(-1).cast("bigint"))
        return found.withColumn(column, number).drop(name)

    return apply


def fit_ordinal(df: DataFrame, column: str, **options: Any) -> Fitted:
    return fit_together(df, [ordinal_fit(column, **options)])[0]


def frequency_fit(column: str) -> Fit:
    """Share of the rows that hold the value; 0 for unseen and missing values."""

    def build(found: Answers) -> Fitted:
        total = found.scalars["rows"]
        table = found.counts[column].withColumn("share", F.col("n") / F.lit(max(total, 1)).cast("double"))
        facts = [fact(column, "frequency", "rows", total)]
        return make("frequency", {"column": column}, facts=facts, outputs={column: [column]}, tables={"shares": table})

    return Fit([column], [column], build, scalars={"rows": F.count(F.lit(1))}, counted=[column])


@step_kind("frequency")
def _shares(data: StepData) -> Transform:
    column = data.params["column"]

    def apply(rows: DataFrame) -> DataFrame:
        found, name = _by_text(rows, data.tables["shares"], column, "share")
        return found.withColumn(column, F.coalesce(quoted(name), F.lit(0.0))).drop(name)

    return apply


def fit_frequency(df: DataFrame, column: str) -> Fitted:
    return fit_together(df, [frequency_fit(column)])[0]


def target_fit(
    column: str,
    target: str,
    *,
    fold_key: list[str] | None = None,
    fold_draw: str | None = None,
    folds: int = 5,
    smoothing: float = 10.0,
    seed: int = 42,
    training_split: str | None = None,
) -> Fit:
    """Smoothed mean of the target per category.

    Training rows get the mean over the other folds, so no row sees its own target; folds are a hash of `fold_key`, or a
    column `fold_draw` that holds one. `training_split` names the column that says "train" for those rows when applying
    (default: all are). Other rows, and rows that are new, get the mean over all folds. Unseen and missing values get the
    overall mean.
    """
    fold = _fold(fold_draw, fold_key, folds, seed)
    known = quoted(target).cast("double")

    def build(found: Answers) -> Fitted:
        sums, overall = found.sums[0], found.scalars["overall"]
        per_category = Window.partitionBy("category")  # at most one row per fold
        n_all, t_all = F.sum("n").over(per_category), F.sum("total").over(per_category)

        def mean(t: Column, n: Column) -> Column:
            return (t + F.lit(smoothing * (overall or 0.0))) / (n + F.lit(smoothing))

        held_out = sums.select("category", "fold", "n", mean(t_all - F.col("total"), n_all - F.col("n")).alias("encoded"))
        whole = sums.groupBy("category").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(
            "category", F.lit(-1).alias("fold"), "n", mean(F.col("total"), F.col("n")).alias("encoded")
        )
        params = {"column": column, "overall": overall, "fold_key": fold_key, "fold_draw": fold_draw, "folds": folds, "seed": seed, "training_split": training_split}
        facts = [fact(column, "target", "overall_mean", overall), fact(column, "target", "smoothing", smoothing)]
        return make("target", params, facts=facts, outputs={column: [column]}, tables={"means": held_out.unionByName(whole)})

    return Fit([column, target], [column], build, scalars={"overall": F.avg(known)}, sums=[(column, known, fold)])


def _fold(fold_draw: str | None, fold_key: list[str] | None, folds: int, seed: int) -> Column:
    drawn = quoted(fold_draw) if fold_draw else draw([quoted(k) for k in fold_key or []], seed)
    return (drawn % folds).cast("int")


@step_kind("target")
def _target_means(data: StepData) -> Transform:
    p = data.params
    column, overall = p["column"], p["overall"]

    def apply(rows: DataFrame) -> DataFrame:
        if data.new_rows:
            mine = F.lit(-1)
        else:
            mine = _fold(p["fold_draw"], p["fold_key"], p["folds"], p["seed"])
            if p["training_split"]:
                mine = F.when(quoted(p["training_split"]) == "train", mine).otherwise(-1)
        name = fresh_name(rows.columns, "encoded")
        side = data.tables["means"].withColumnRenamed("encoded", name)
        found = lookup(rows, side, {"category": quoted(column).cast("string"), "fold": mine}, weight="n")
        return found.withColumn(column, F.coalesce(quoted(name), F.lit(overall).cast("double"))).drop(name)

    return apply


def fit_target(df: DataFrame, column: str, target: str, **options: Any) -> Fitted:
    return fit_together(df, [target_fit(column, target, **options)])[0]


def hashing(columns: list[str], buckets: int, *, portable: bool = False) -> Fitted:
    """Bucket number of the value. `portable` uses md5, which other engines can repeat."""
    params = {"columns": columns, "buckets": buckets, "portable": portable}
    return make("hashing", params, facts=[fact(c, "hashing", "buckets", buckets) for c in columns], outputs={c: [c] for c in columns})


@step_kind("hashing")
def _buckets(data: StepData) -> Transform:
    bucket = text_bucket if data.params["portable"] else fast_bucket
    return lambda rows: rows.withColumns({c: bucket(quoted(c), data.params["buckets"]) for c in data.params["columns"]})

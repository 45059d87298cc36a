"""What quality issues call for: drop copies, empty and constant columns, unlabelled rows, ids; rebalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.columns import present, quoted
from tableprep.functions.hashing import row_fingerprint, unit_draw
from tableprep.functions.joins import lookup


def drop_duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of every group of copies; with `columns`, one row per value of these.

    Most rows have no copy and need no shuffle: a count of 128-bit row fingerprints finds those that
    may have one, and only they are compared whole. Copies are combined before the shuffle.
    """
    if columns is not None:
        return df.dropDuplicates(columns)
    h0, h1 = row_fingerprint(df)
    marked = df.withColumns({"__h0": h0, "__h1": h1})
    repeated = marked.groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    found = lookup(marked, repeated.withColumn("__copied", F.lit(True)), ["__h0", "__h1"], weight="__n")
    single = found.where(F.col("__copied").isNull()).select(df.columns)
    copied = found.where(F.col("__copied"))
    if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):  # maps cannot be compared
        return single.unionByName(copied.dropDuplicates(["__h0", "__h1"]).select(df.columns))
    return single.unionByName(copied.select(df.columns).dropDuplicates())


def columns_with_issue(issues: DataFrame, issue_type: str) -> list[str]:
    """Names of the columns an issue is about; at most one row per column."""
    hit = issues.where(F.col("issue_type") == issue_type).select(F.explode("columns").alias("name"))
    return [r["name"] for r in hit.collect()]


def drop_all_missing(df: DataFrame, issues: DataFrame) -> DataFrame:
    return df.drop(*columns_with_issue(issues, "all_missing_column"))


def drop_constant(df: DataFrame, issues: DataFrame) -> DataFrame:
    return df.drop(*columns_with_issue(issues, "constant_column"))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(df, target).isNotNull())


def drop_identifiers(df: DataFrame, roles: DataFrame) -> DataFrame:
    ids = roles.where(F.col("role") == "identifier").select("name").collect()
    return df.drop(*[r["name"] for r in ids])


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(quoted(label).isNotNull()).groupBy(quoted(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * n)."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return counts.withColumn("weight", F.lit(whole["rows"] or 0) / (F.lit(whole["classes"] or 1) * F.col("n")))


def add_class_weights(df: DataFrame, label: str, *, out: str = "class_weight") -> DataFrame:
    table = class_weights(df, label).withColumnRenamed("weight", out)
    return lookup(df, table, [label], weight="n")


def rebalance(df: DataFrame, label: str, key: list[str], *, method: str = "under", seed: int = 42) -> DataFrame:
    """Resample classes to equal size: `under` thins to the smallest, `over` repeats up to the largest.

    Whether a row stays, or is repeated once more, follows from a hash of its key, so a retried
    task draws the same rows. Rows without a label are left out.
    """
    counts = class_counts(df, label)
    ends = counts.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    goal = ends["low"] if method == "under" else ends["high"]
    table = counts.withColumn("__share", F.lit(goal or 0) / F.col("n"))
    rated = lookup(df.where(quoted(label).isNotNull()), table, [label], weight="n")
    whole = F.floor("__share").cast("int")
    extra = (unit_draw([quoted(k) for k in key], seed) < F.col("__share") - whole).cast("int")
    copies = rated.withColumn("__copies", whole + extra).where(F.col("__copies") > 0)
    if method == "over":
        copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copy")
    return copies.select(df.columns)

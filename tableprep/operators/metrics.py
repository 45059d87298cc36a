"""Evaluation metrics over a table of predictions."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import quoted


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(rows, accuracy, macro_f1) from counts per (truth, predicted) pair."""
    pairs = df.groupBy(quoted(truth).alias("t"), quoted(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.inline(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("called"), hit.alias("right")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("right")),
    ))
    per_class = pairs.select(sides).groupBy("label").agg(
        F.sum("actual").alias("actual"), F.sum("called").alias("called"), F.sum("right").alias("right")
    )
    f1 = F.lit(2.0) * F.col("right") / (F.col("actual") + F.col("called"))
    return per_class.agg(
        F.sum("actual").alias("row_count"),
        (F.sum("right") / F.sum("actual")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
    )


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts with precision, recall and f1 of class 1."""
    t, p = quoted(truth) == 1, quoted(predicted) == 1
    counted = df.agg(
        F.count_if(t & p).alias("true_positives"), F.count_if(~t & p).alias("false_positives"),
        F.count_if(t & ~p).alias("false_negatives"), F.count_if(~t & ~p).alias("true_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return counted.select(
        "*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> float:
    """Exact area under the ROC curve; every distinct score is a threshold."""
    rows = df.select(quoted(truth).cast("double").alias("label"), quoted(score).cast("double").alias("score"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(rows)


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(row_count, rmse, mae, r2, mape) in one pass. mape leaves out true values of 0."""
    t, p = quoted(truth).cast("double"), quoted(predicted).cast("double")
    error = t - p
    sums = df.where(t.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(t).alias("spread"),
        F.avg(F.abs(error / F.nullif(t, F.lit(0.0)))).alias("mape"),
    )
    return sums.select(
        "row_count", F.sqrt("mse").alias("rmse"), "mae",
        (F.lit(1.0) - F.col("mse") / F.nullif(F.col("spread"), F.lit(0.0))).alias("r2"), "mape",
    )


def silhouette_score(df: DataFrame, features: str, cluster: str) -> float:
    """Mean silhouette with squared Euclidean distance, from cluster sums rather than all pairs."""
    rows = df.select(
        array_to_vector(quoted(features).cast("array<double>")).alias("features"),
        quoted(cluster).cast("int").alias("prediction"),
    )
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(rows)

"""Accuracy, weighted precision, recall and F1, confusion counts, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kategora.functions.scores import cross_entropy


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows for each pair of true and predicted class."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: ``accuracy`` and support-weighted ``precision``, ``recall``, ``f1``.

    A class that is never predicted, or never right, adds zero. All work after the confusion
    counts runs over at most one row per pair of classes.
    """
    of_class, of_guess = Window.partitionBy("label"), Window.partitionBy("prediction")
    cells = confusion(df, label, prediction).select(
        "*",
        F.sum("n").over(of_class).alias("support"),
        F.sum("n").over(of_guess).alias("guessed"),
    )
    right = F.when(F.col("label") == F.col("prediction"), F.col("n").cast("double"))
    p, r = F.col("n") / F.col("guessed"), F.col("n") / F.col("support")

    def weighted(value):
        hit = F.col("label") == F.col("prediction")
        return F.coalesce(F.sum(F.when(hit, value * F.col("support"))), F.lit(0.0)) / F.sum("n")

    return cells.agg(
        (F.coalesce(F.sum(right), F.lit(0.0)) / F.sum("n")).alias("accuracy"),
        weighted(p).alias("precision"),
        weighted(r).alias("recall"),
        weighted(2 * p * r / (p + r)).alias("f1"),
    )


def log_loss(df: DataFrame, logits: str, label: str, out: str = "loss") -> DataFrame:
    """Add each row's cross-entropy."""
    return df.withColumn(out, cross_entropy(F.col(logits), F.col(label)))


def mean_loss(df: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Mean of the batches' mean losses; a short last batch weighs as much as a full one."""
    means = df.groupBy(batch).agg(F.avg(loss).alias("_mean"))
    return means.agg(F.avg("_mean").alias("mean_loss"))

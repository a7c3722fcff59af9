"""Class vocabularies and the mapping between class names and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kategora.plans.storage import pinned


def _numbered(classes: DataFrame, *order: str) -> DataFrame:
    # One row per class: the window runs over the class list, not over the data.
    number = F.row_number().over(Window.orderBy(*order)) - 1
    return classes.select(number.cast("int").alias("label"), "category")


def label_vocab(
    df: DataFrame, col: str = "category", order: str = "sorted", order_col: str | None = None
) -> DataFrame:
    """``(label, category)``, numbered from 0 by name or by first appearance."""
    named = df.filter(F.col(col).isNotNull())
    category = F.col(col).alias("category")
    if order == "sorted":
        return _numbered(named.select(category).distinct(), "category")
    if order == "first_seen":
        seen = named.groupBy(category).agg(F.min(order_col).alias("_seen"))
        return _numbered(seen, "_seen", "category")
    raise ValueError(f"order must be sorted or first_seen, not {order!r}")


def label_vocab_from(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Vocabulary of a given list of class names; numbers follow the sorted names."""
    listed = spark.createDataFrame([(n,) for n in names], "category string")
    return _numbered(listed.distinct(), "category")


def encode_labels(
    df: DataFrame, vocab: DataFrame, col: str = "category", on_unknown: str = "null"
) -> DataFrame:
    """Add ``label``. A class not in the vocabulary gives NULL, or an error if so asked."""
    known = pinned(vocab.select("label", F.col("category").alias(col)))
    encoded = df.join(known, col, "left")
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(F.col(col), F.lit("NULL"))))
        encoded = encoded.withColumn("label", F.coalesce(F.col("label"), unknown.cast("int")))
    return encoded.select(*df.columns, "label")


def decode_labels(
    df: DataFrame, vocab: DataFrame, col: str = "label", out: str = "category", on_unknown: str = "null"
) -> DataFrame:
    """Add the class name for the class number in ``col``. A number not in the vocabulary gives NULL, or an error if so asked."""
    known = pinned(vocab.select(F.col("label").alias(col), F.col("category").alias(out)))
    decoded = df.join(known, col, "left")
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL"))))
        decoded = decoded.withColumn(out, F.coalesce(F.col(out), unknown.cast("string")))
    return decoded.select(*df.columns, out)

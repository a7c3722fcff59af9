"""The shared test tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies: its files decide how many tasks read it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text, category, source)`` with the language as category."""
    docs = load(spark, folder, "documents")
    return docs.select("doc_id", "text", F.col("lang").alias("category"), "source")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their first line as title and the rest as content."""
    title = F.substring_index("text", "\n", 1)
    content = F.substr("text", F.length(title) + 2)
    return documents(spark, folder).select(
        "doc_id", "category", "source", title.alias("title"), content.alias("content")
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """``(vec_id, label, logits)``: every entry of a vector as the score of a class."""
    return load(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, epoch, loss)``: a user's mean event value per day, days counted from 1.

    Averaging before anything else leaves one row per user and day, however busy a user is.
    """
    events = load(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return events.groupBy(F.col("user_id").alias("run"), day.alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("loss")
    )

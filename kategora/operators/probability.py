"""Table of the union probability of two independent events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.functions.scores import union_probability


def probability_grid(spark: SparkSession, n: int = 100) -> DataFrame:
    """``(p_A, p_B, p_A_or_B)`` for ``n`` evenly spaced values of each from 0 to 1."""
    step = F.lit(float(n - 1))
    cells = spark.range(n * n).select(
        (F.floor(F.col("id") / n) / step).alias("p_A"), ((F.col("id") % n) / step).alias("p_B")
    )
    return with_union(cells)


def with_union(df: DataFrame, a: str = "p_A", b: str = "p_B", out: str = "p_A_or_B") -> DataFrame:
    """Add the probability that at least one of the two events happens."""
    return df.withColumn(out, union_probability(F.col(a), F.col(b)))

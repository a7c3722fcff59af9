"""Decisions and losses on arrays of class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union_probability(a: Column, b: Column) -> Column:
    """Probability that at least one of two independent events happens."""
    return a + b - a * b


def argmax(scores: Column) -> Column:
    """0-based index of the greatest entry; the first wins a tie, NaN beats numbers."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def decide(scores: Column, threshold: float = 0.5) -> Column:
    """Class of a score array: threshold on a single score, argmax otherwise."""
    single = F.when(F.get(scores, F.lit(0)) < threshold, 0).otherwise(1)
    return F.when(F.size(scores) == 1, single).otherwise(argmax(scores)).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Softmax cross-entropy of one row of logits against its class index."""
    values = logits.cast("array<double>")
    top = F.array_max(values)
    mass = F.aggregate(
        F.transform(values, lambda z: F.exp(z - top)), F.lit(0.0), lambda acc, e: acc + e
    )
    return F.log(mass) - (F.get(values, label) - top)

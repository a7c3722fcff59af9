"""Counts, profiles and previews of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first; with ``dropna=False`` NULL is counted too."""
    seen = df.filter(F.col(col).isNotNull()) if dropna else df
    return seen.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def min_class_size(df: DataFrame, col: str) -> DataFrame:
    """Size of the smallest class."""
    return value_counts(df, col).agg(F.min("count").alias("min_count"))


def categories(df: DataFrame, col: str = "category") -> DataFrame:
    """Distinct categories, each with their number."""
    named = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return named.withColumn("n_categories", F.count(F.lit(1)).over(Window.partitionBy()))


def count_empty(df: DataFrame, cols: Sequence[str] = ("title", "content")) -> DataFrame:
    """One row with the number of empty texts in each column."""
    return df.agg(*[F.count_if(F.col(c) == "").alias(f"empty_{c}") for c in cols])


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long")
    )


def profile(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, non_null)`` of every column, from one pass."""
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return filled.select(F.inline(F.array(*rows)))


def head(df: DataFrame, n: int = 5, order_col: str | None = None) -> DataFrame:
    """The first rows."""
    return (df.orderBy(order_col) if order_col else df).limit(n)


# Columns a pivot may make. A wider table is better left long.
PIVOT_COLUMNS = 1_000


def pivot(
    df: DataFrame, index: str, columns: str, values: str, names: Sequence | None = None
) -> DataFrame:
    """Long to wide, one value per cell; two values for a cell are an error.

    Naming the new columns in ``names`` saves the pass that looks for them; a row of another column
    is then an error. Without names, more than ``PIVOT_COLUMNS`` columns are an error.
    """
    if names is None:
        found = df.select(columns).distinct().limit(PIVOT_COLUMNS + 1).collect()
        if len(found) > PIVOT_COLUMNS:
            raise ValueError(f"{columns} has more than {PIVOT_COLUMNS} values")
        names = sorted((r[0] for r in found if r[0] is not None), key=str)
        if len(names) < len(found):
            raise ValueError(f"{columns} has NULLs, which name no column")
    kind = df.schema[values].dataType

    def fail(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast(kind)

    known = F.coalesce(F.col(columns).isin(list(names)), F.lit(False))
    grouped = df.groupBy(index, columns).agg(F.first(values).alias("_value"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(~known, fail(f"a value of {columns} is not among the names"))
    checked = checked.when(F.col("_n") > 1, fail("two values for one cell")).otherwise(F.col("_value"))
    # All cells of a row pass through the check, also those that make no column.
    cells = grouped.groupBy(index).agg(
        *[F.max(F.when(F.col(columns) == n, checked)).alias(str(n)) for n in names],
        F.count(F.when(~known, checked)).alias("_others"),
    )
    return cells.filter(F.col("_others") == 0).drop("_others")

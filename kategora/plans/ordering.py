"""Exact ranks without sorting whole groups.

A split, a sample or the last n rows of a class need only the order key at some rank of the
group. It is found in two steps: a histogram of the keys over order-preserving buckets (one row
per group and bucket after map-side counting), then an exact ranking of the rows of the single
bucket that holds the rank. A hot group is thus never sorted by one task, and the wide rows are
filtered where they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kategora.plans.storage import pinned

HASH_DIGITS = 3
KEY_BUCKETS = 1_024
# Rows from which the buckets of keys that are no numbers are chosen, and how many splitters are compared at once.
SAMPLE = 8_192
STEP = 32


@dataclass(frozen=True)
class Order:
    """A total order of rows: ``columns`` by name, and a bucket that never decreases along it."""

    columns: dict[str, Column]
    bucket: Callable[[DataFrame], DataFrame]

    def tagged(self, df: DataFrame, keep: list[str]) -> DataFrame:
        narrow = df.select(*keep, *[c.alias(n) for n, c in self.columns.items()])
        return self.bucket(narrow)

    def value(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self.columns.items()])


def hash_order(key: str, seed: int, digits: int = HASH_DIGITS) -> Order:
    """Seeded random order that depends on the row key only, not on partitioning."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"-{seed}")))
    return Order(
        {"_hash": digest, "_key": F.col(key)},
        lambda df: df.withColumn("_bucket", F.conv(F.substring("_hash", 1, digits), 16, 10).cast("int")),
    )


def key_order(key: str, buckets: int = KEY_BUCKETS) -> Order:
    """Order by a key of any type that can be ordered, NULL first. Ranks are exact.

    Buckets of a number come from approximate quantiles, those of other types from a sample of
    ``SAMPLE`` rows, drawn evenly: they decide how evenly the work is spread, never the result.
    """
    least = -1.7976931348623157e308

    def bucket(df: DataFrame) -> DataFrame:
        kind = df.schema["_key"].dataType
        if not isinstance(kind, T.NumericType):
            return df.withColumn("_bucket", _place(F.col("_key"), _splitters(df, buckets), kind))
        cast = df.withColumn("_value", F.coalesce(F.col("_key").cast("double"), F.lit(least)))
        model = QuantileDiscretizer(
            numBuckets=buckets, inputCol="_value", outputCol="_quantile", relativeError=1 / (4 * buckets)
        ).fit(cast)
        return (
            model.transform(cast)
            .withColumn("_bucket", F.col("_quantile").cast("int"))
            .drop("_value", "_quantile")
        )

    return Order({"_key": F.col(key)}, bucket)


def _splitters(df: DataFrame, buckets: int) -> list:
    """Keys that part the rows about evenly, in order; the smallest hashes are an even sample, and each task keeps no more of them."""
    keys = df.select("_key", F.xxhash64("_key", F.monotonically_increasing_id()).alias("_hash")).filter("_key is not null")
    sample = [r["_key"] for r in keys.orderBy("_hash").limit(SAMPLE).orderBy("_key").collect()]
    chosen = sample[:: max(1, len(sample) // buckets)][1:]
    return [k for k, before in zip(chosen, [None, *chosen]) if k != before]


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def _place(key: Column, splitters: list, kind: T.DataType) -> Column:
    """How many splitters are not above a key, found in two steps: among every ``STEP``-th, then between two of them."""
    listed = lambda keys: F.array(*[_literal(k, kind) for k in keys]).cast(T.ArrayType(kind))
    passed = lambda keys: F.size(F.filter(keys, lambda s: s <= key))
    coarse = passed(listed(splitters[STEP - 1 :: STEP]))
    fine = F.array(*[listed(splitters[i : i + STEP - 1]) for i in range(0, max(len(splitters), 1), STEP)])
    # The last part has no splitter behind it.
    inner = F.coalesce(passed(F.get(fine, coarse)), F.lit(0))
    return F.when(key.isNull(), -1).otherwise(coarse * STEP + F.greatest(inner, F.lit(0))).cast("int")


def rank_cuts(
    df: DataFrame,
    by: list[str],
    order: Order,
    names: list[str],
    ranks: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Order value at the wanted ranks, one row per group: ``by``, ``n`` and a column per name.

    ``ranks`` gets the table of groups (``by``, size ``n``, smallest value ``first``) and adds a
    rank column for each name; windows over that table are fine, it has one row per group.
    A rank of zero gives NULL.
    """
    narrow = order.tagged(df, by)
    keys = list(order.columns)
    counts = narrow.groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_c"), F.min(F.struct(*keys)).alias("_first")
    )
    groups = counts.groupBy(*by).agg(
        F.sum("_c").alias("n"),
        F.min("_first").alias("first"),
        F.sort_array(F.collect_list(F.struct("_bucket", "_c"))).alias("_hist"),
    )
    groups = ranks(groups)
    inner = Window.partitionBy(*by).orderBy("_bucket")
    buckets = groups.select(
        *by, "n", *names, F.inline("_hist")
    ).withColumn("_below", F.sum("_c").over(inner) - F.col("_c"))
    asked = F.array(
        *[
            F.struct(
                F.lit(name).alias("_name"),
                (F.col(name).cast("long") - F.col("_below")).alias("_at"),
            )
            for name in names
        ]
    )
    targets = pinned(
        buckets.select(*by, "n", "_bucket", "_c", F.inline(asked))
        .filter(F.col("_at").between(F.lit(1), F.col("_c")))
        .drop("_c")
    )
    place = Window.partitionBy(*by, "_bucket", "_name").orderBy(*keys)
    found = (
        narrow.join(targets, [*by, "_bucket"])
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") == F.col("_at"))
    )
    return pinned(
        found.groupBy(*by).agg(
            F.first("n").alias("n"),
            *[
                F.max(F.when(F.col("_name") == name, F.struct(*keys))).alias(name)
                for name in names
            ],
        )
    )


def within(order: Order, cut: str) -> Column:
    """True for rows up to and including the cut; false where there is no cut."""
    return F.coalesce(order.value() <= F.col(cut), F.lit(False))


def with_cuts(df: DataFrame, by: list[str], cuts: DataFrame, names: list[str]) -> DataFrame:
    """Attach the cut columns: a small join, or literals when there is one group only."""
    if by:
        return df.join(cuts.drop("n"), by, "left")
    row = cuts.select(*names).first()
    for name in names:
        kind = cuts.schema[name].dataType
        cut = row[name] if row else None
        literal = F.lit(None)
        if cut:
            literal = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kind])
        df = df.withColumn(name, literal.cast(kind))
    return df


def positions(df: DataFrame, order: Order, out: str) -> DataFrame:
    """Global 1-based position of every row, ranked bucket by bucket."""
    keep = df.columns
    tagged = order.bucket(df.select("*", *[c.alias(n) for n, c in order.columns.items()]))
    offsets = pinned(
        tagged.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_bucket", (F.sum("_c").over(Window.orderBy("_bucket")) - F.col("_c")).alias("_below"))
    )
    place = Window.partitionBy("_bucket").orderBy(*order.columns)
    return (
        tagged.join(offsets, "_bucket")
        .withColumn(out, F.row_number().over(place) + F.col("_below"))
        .select(*keep, out)
    )

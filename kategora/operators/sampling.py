"""Per-class selection, balancing, splits, folds and batches.

"Random" means ordered by a seeded hash of the row key: the outcome does not depend on how the
rows are partitioned, and a re-run after a lost executor draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kategora.plans.ordering import hash_order, key_order, positions, rank_cuts, with_cuts, within


def tail_per_group(df: DataFrame, by: str, n: int, order_col: str) -> DataFrame:
    """The last ``n`` rows of each group along ``order_col``."""
    order = key_order(order_col)
    named = df.filter(F.col(by).isNotNull())
    rank = F.greatest(F.col("n") - n + 1, F.lit(1))
    cuts = rank_cuts(named, [by], order, ["from"], lambda groups: groups.withColumn("from", rank))
    return (
        with_cuts(named, [by], cuts, ["from"])
        .filter(order.value() >= F.col("from"))
        .select(*df.columns)
    )


def balance(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Random rows of each class, as many as the smallest class has."""
    order = hash_order(key, seed)
    named = df.filter(F.col(by).isNotNull())
    smallest = F.min("n").over(Window.partitionBy())
    cuts = rank_cuts(
        named, [by], order, ["upto"], lambda groups: groups.withColumn("upto", smallest)
    )
    return with_cuts(named, [by], cuts, ["upto"]).filter(within(order, "upto")).select(*df.columns)


def held_out(n: Column, share: float) -> Column:
    """Size of a held-out part: the share, rounded up."""
    return F.ceil(n.cast("double") * F.lit(float(share)))


def _stratified_sizes(groups: DataFrame, by: str, share: float) -> DataFrame:
    """Held-out rows per class, adding up to the overall held-out size.

    The kept rows are spread by whole shares first; what is left goes to the classes with the
    greatest fractional share (then by name).
    """
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    return (
        groups.withColumn("_kept", total - held_out(total, share))
        .withColumn("_exact", F.col("n") * F.col("_kept") / total)
        .withColumn("_whole", F.floor("_exact"))
        .withColumn("_missing", F.col("_kept") - F.sum("_whole").over(everything))
        .withColumn("_part", F.round(F.col("_exact") - F.col("_whole"), 9))
        .withColumn("_turn", F.row_number().over(Window.orderBy(F.desc("_part"), by)))
        .withColumn("_extra", F.when(F.col("_turn") <= F.col("_missing"), 1).otherwise(0))
        .withColumn("upto", F.col("n") - F.col("_whole") - F.col("_extra"))
    )


def split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add ``part`` (``train`` or ``test``); the test part has the share rounded up."""
    order = hash_order(key, seed)
    by = [stratify] if stratify else []

    def sizes(groups: DataFrame) -> DataFrame:
        if stratify:
            return _stratified_sizes(groups, stratify, test)
        return groups.withColumn("upto", held_out(F.col("n"), test))

    cuts = rank_cuts(df, by, order, ["upto"], sizes)
    part = F.when(within(order, "upto"), "test").otherwise("train").alias("part")
    return with_cuts(df, by, cuts, ["upto"]).select(*df.columns, part)


def split3(df: DataFrame, key: str, held: float = 0.2, test: float = 0.5, seed: int = 369) -> DataFrame:
    """Add ``part``: hold out a share, then divide it into ``test`` and ``validation``."""
    order = hash_order(key, seed)
    names = ["tested", "held"]
    cuts = rank_cuts(
        df,
        [],
        order,
        names,
        lambda groups: groups.withColumn("held", held_out(F.col("n"), held)).withColumn(
            "tested", held_out(F.col("held"), test)
        ),
    )
    part = (
        F.when(within(order, "tested"), "test")
        .when(within(order, "held"), "validation")
        .otherwise("train")
    )
    return with_cuts(df, [], cuts, names).select(*df.columns, part.alias("part"))


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 369) -> DataFrame:
    """A random fraction of the rows, rounded to the nearest count."""
    order = hash_order(key, seed)
    rank = F.rint(F.col("n").cast("double") * F.lit(float(fraction)))
    cuts = rank_cuts(df, [], order, ["upto"], lambda groups: groups.withColumn("upto", rank))
    return with_cuts(df, [], cuts, ["upto"]).filter(within(order, "upto")).select(*df.columns)


def remainder(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the sample."""
    return df.join(sample.select(key), key, "left_anti")


def assign_folds(df: DataFrame, k: int, by: str, order_col: str) -> DataFrame:
    """Add ``fold`` (0-based): consecutive stretches of each class along ``order_col``.

    Classes are laid end to end in order of first appearance and dealt out in turn to the folds,
    which fixes how many rows of a class each fold gets.
    """
    order = key_order(order_col)
    names = [f"end{fold}" for fold in range(k - 1)]
    laid = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)

    def dealt(upto: Column, fold: int) -> Column:
        return F.floor((upto - fold + k - 1) / k)

    def ends(groups: DataFrame) -> DataFrame:
        groups = groups.withColumn("_start", F.coalesce(F.sum("n").over(laid), F.lit(0)))
        start, end, upto = F.col("_start"), F.col("_start") + F.col("n"), F.lit(0)
        for fold, name in enumerate(names):
            upto = upto + dealt(end, fold) - dealt(start, fold)
            groups = groups.withColumn(name, upto)
        return groups

    cuts = rank_cuts(df, [by], order, names, ends)
    # An end of rank zero has no cut: that fold got no row of the class.
    passed = [F.when(F.col(n).isNull() | (order.value() > F.col(n)), 1).otherwise(0) for n in names]
    fold = sum(passed[1:], passed[0]).cast("int").alias("fold")
    return with_cuts(df, [by], cuts, names).select(*df.columns, fold)


def assign_batches(
    df: DataFrame, size: int, key: str, shuffle: bool = False, seed: int = 42
) -> DataFrame:
    """Add ``batch`` (0-based): ``size`` rows each, in key order or shuffled.

    The rank travels with the row, so every row gets one batch: also rows of equal keys, which follow
    each other, and rows with a NULL key, which come first in key order.
    """
    order = hash_order(key, seed) if shuffle else key_order(key)
    batch = F.floor((F.col("_position") - 1) / size).cast("long").alias("batch")
    return positions(df, order, "_position").select(*df.columns, batch)

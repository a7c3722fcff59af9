"""Connected components of a graph that may have hubs and long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kategora.plans.storage import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (columns ``u``, ``v``); ``root`` is the smallest node of a component.

    Alternates two steps: every node links its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Neighbourhoods are only ever reduced to their minimum, so a hub
    is no group to hold. Every round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest chain.
    """
    now = staged(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = staged(_small(_large(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return links.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

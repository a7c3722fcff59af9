"""Exact dedup by salted combining; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kategora.plans.storage import staged

# Runs of white space that are not already one plain space; replacing only these gives the same
# text as replacing every run, with far fewer matches.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SALTS = 16


def normalised(text: str) -> Column:
    """Text with each run of ASCII white space as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), RUNS, " ")


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS, digest_hex: int = 64
) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white-space runs became one space. Of equal texts the row
    with the smallest key stays; of repeated rows with that key, one. NULL texts count as empty,
    NULL keys lose against any other key, an empty table gives an empty result, other columns are
    ignored.

    Combining runs in three stages, each grouping by the digest *and* the whole text: inside the
    scan task (partial aggregation), per salt, and over the salt winners. A hot group therefore
    reaches the last stage as one row per salt and task, never as its rows. Members find their
    winner by digest alone, which is exact where a digest has a single text; where it has several
    (``digest_hex`` below 64 makes that happen in tests), those texts are compared once more.
    """
    sha = F.sha2(F.col("norm"), 256)
    rows = docs.select(F.col(key).alias("id"), normalised(text).alias("norm")).select(
        "id", "norm", F.unhex(sha).alias("sha")
    )
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_hex // 2))
    salted = rows.select("id", "norm", "digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    per_salt = salted.groupBy("digest", "norm", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    groups = per_salt.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    # One row for each digest and text, without the text: all the later steps are narrow.
    winners = staged(groups.select("digest", "keep_id", "group_size"), "exact-winners")
    several = winners.groupBy("digest").count().filter("count > 1").select("digest")

    # Copies of a row (same key, same text) are told apart by a number.
    nth = F.row_number().over(Window.partitionBy("id", "sha", "digest").orderBy("id"))
    members = rows.select("id", "sha", "digest").withColumn("nth", nth)
    shared = winners.filter("group_size > 1")
    if several.isEmpty():
        found = members.join(shared, "digest", "left")
    else:
        alone = members.join(several, "digest", "left_anti").join(shared, "digest", "left")
        mixed = rows.join(several, "digest", "left_semi")
        texts = mixed.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        again = mixed.join(texts, ["digest", "norm"]).withColumn("nth", nth)
        found = alone.unionByName(again.select(alone.columns))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        size.alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""

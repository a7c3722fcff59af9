"""Term frequencies, document frequencies and TF-IDF weights as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kategora.functions.text import term_counts
from kategora.operators.postings import doc_terms, unnested
from kategora.plans.skew import lookup, measure
from kategora.plans.storage import staged


def term_freq(
    df: DataFrame, keep: Sequence[str], text: str = "text", lo: int = 1, hi: int = 1, outer: bool = False
) -> DataFrame:
    """One row per document and term: the columns ``keep``, ``term`` and its count ``tf``.

    Counting happens inside each row, so there is no shuffle. With ``outer`` a document without
    terms keeps one row whose term is NULL.
    """
    unfold = F.inline_outer if outer else F.inline
    return df.select(*keep, unfold(term_counts(F.col(text), lo, hi)))


def doc_freq(tf: DataFrame, min_df: int = 1) -> DataFrame:
    """Number of documents with each term, for terms found in at least ``min_df``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def smooth_idf(df: Column, n: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def tfidf_fit(
    df: DataFrame, text: str = "text", lo: int = 1, hi: int = 1, min_df: int = 1, n: int | None = None
) -> DataFrame:
    """Vocabulary of the training documents: ``(term, df, idf)``, written once.

    ``n`` is the number of training documents, counted here if not given.
    """
    size = df.count() if n is None else n
    counts = doc_terms(df, [], text, lo, hi).groupBy("term").agg(F.sum(F.size("tf")).cast("long").alias("df"))
    counts = counts.filter(F.col("df") >= min_df)
    return staged(counts.withColumn("idf", smooth_idf(F.col("df"), F.lit(size))), "terms")


def tfidf_norms(weighted: DataFrame, key: str) -> DataFrame:
    """Euclidean length of each document's vector of ``tf * idf``."""
    raw = F.col("tf") * F.col("idf")
    return weighted.groupBy(key).agg(F.sqrt(F.sum(raw * raw)).alias("norm"))


def tfidf_transform(
    df: DataFrame, terms: DataFrame, key: str, text: str = "text", lo: int = 1, hi: int = 1
) -> DataFrame:
    """Unit-length TF-IDF weights ``(key, term, weight)``; terms outside the vocabulary are left out.

    The lengths are computed from the map-side sums of each document and joined back, instead of
    shuffling and sorting every weight by document.
    """
    size = measure(terms, "df")
    each = lookup(doc_terms(df, [key], text, lo, hi), terms, "term", "df", key, "inner", size)
    norms = staged(tfidf_norms(unnested(each, [key, "tf"]), key), "norms")
    scaled = lookup(doc_terms(df.join(norms, key), [key, "norm"], text, lo, hi), terms, "term", "df", key, "inner", size)
    return unnested(scaled, [key, "norm", "tf"]).select(
        key, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")
    )

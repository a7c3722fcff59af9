"""From raw documents to packed sequences: five stages, each written and read again.

All stages take NULLs in any column, empty and long texts, ties, repeated rows, empty tables and extra
columns with any names. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.llm import jaccard_join, line_dedup, packing, quality_rules, secret_scan
from kategora.plans.storage import staged


def measured(docs: DataFrame) -> DataFrame:
    """Rows whose text a stage may have changed, with their number of characters brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules; NULL and empty texts do not, repeated rows pass or go together."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that an earlier document has too, alike or by template; NULL texts stay NULL."""
    return measured(line_dedup.drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest key; of repeated rows one stays."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark; NULL texts stay NULL."""
    return measured(secret_scan.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence; a NULL or empty text is one closing token."""
    return packing.pack(docs, packing.read_definition(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
# Perplexity, automaton and tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of the documents table; what is between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
    return docs

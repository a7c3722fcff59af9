"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.llm import byte_bpe, chat_format, exact_dedup, html_text, jaccard_join, language_id, line_dedup, merkle, packing, quality_rules, secret_scan, spelling, vector_file


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(bpe.encode(table(spark, folder, "documents")), bpe)


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat_format.probe(spark, table(spark, folder, "conversations"))
    return chat_format.digests(chat_format.prefix_examples(turns))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    definition = packing.read_definition(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, folder, "documents"), definition)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Text left of every document, by its digest, and how many lines were dropped."""
    kept = line_dedup.drop_lines(table(spark, folder, "documents"), count="n_dropped")
    return kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "n_dropped")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, folder, "documents")))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit_languages(docs.filter(~language_id.held_out()))
    found = language_id.predict_languages(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.jaccard_join(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "text_id", "n_links", "n_text_links")


def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return vector_file.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digests(merkle.manifest(table(spark, folder, "documents"), merkle.tampered()))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_chat_format": op2_chat_format,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_line_dedup": op5_line_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_language_id": op7_language_id,
        "op8_quality_rules": op8_quality_rules,
        "op9_html_extraction": op9_html_extraction,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_exact_top_k": op11_exact_top_k,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.SQL,
        "op3_exact_dedup": exact_dedup.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op11_exact_top_k": vector_file.SQL,
        "op12_spelling_variants": spelling.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }

"""Queries whose feature is files: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.checks.tables import articles, documents, load
from kategora.operators import bayes
from kategora.operators.sampling import split, tail_per_group
from kategora.plans.ordering import key_order, positions
from kategora.plans.storage import shared_dir
from kategora.sources.archives import read_zipped_csv, write_zipped_csv
from kategora.sources.articles import read_articles, write_csv
from kategora.sources.corpus import read_corpus, read_corpus_body, write_corpus

# Bytes of the table that are written to one file, and splits that small files are cut into at most.
FILE_BYTES = 32 << 20
SPLITS = 1_024


def registered() -> dict:
    return {
        "csv_round_trip": csv_round_trip,
        "csv_gzip": csv_gzip,
        "csv_tail": csv_tail,
        "csv_first": csv_first,
        "csv_split": csv_split,
        "zip_round_trip": zip_round_trip,
        "corpus_round_trip": corpus_round_trip,
        "corpus_body": corpus_body,
        "model_round_trip": model_round_trip,
        "score_benchmark": score_benchmark,
    }


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _total(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``; none of them is opened."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def _files_for(spark: SparkSession, folder: str, least: int) -> int:
    """Files to write the articles to: ``least`` for a small table, for a large one so many that none grows with it."""
    return max(least, _total(spark, f"{folder}/documents.parquet") // FILE_BYTES)


def _digests(read: DataFrame, key: Column) -> DataFrame:
    return read.select(key.alias("doc_id"), F.md5("title").alias("title"), F.md5("content").alias("content"), "category")


def csv_round_trip(spark: SparkSession, folder: str, compression: str | None = None) -> DataFrame:
    """Articles written as CSV and read again; empty fields come back as NULL."""
    path = _folder(spark, "csv")
    made = articles(spark, folder)
    write_csv(made.select(F.col("source").alias("url"), "title", "content", "category", F.col("doc_id").alias("user")), path, compression)
    return _digests(read_articles(spark, f"{path}/*.csv*"), F.col("user").cast("long"))


def csv_gzip(spark: SparkSession, folder: str) -> DataFrame:
    return csv_round_trip(spark, folder, "gzip")


def csv_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Last articles of each category, in the order of several files that are read together."""
    path = _folder(spark, "csv")
    made = articles(spark, folder).repartitionByRange(_files_for(spark, folder, 5), "doc_id").sortWithinPartitions("doc_id")
    write_csv(made.select(F.col("source").alias("url"), "title", "content", "category", F.col("doc_id").alias("user")), path)
    last = tail_per_group(read_articles(spark, f"{path}/*.csv"), "category", 30, "row_key")
    return last.select(F.col("user").cast("long").alias("doc_id"), "category")


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select(F.col("source").alias("url"), "title", "content", "category", F.col("doc_id").alias("user"))


def csv_first(spark: SparkSession, folder: str) -> DataFrame:
    """Of several files only the first by name."""
    path = _folder(spark, "csv")
    parted = _table(spark, folder).withColumn("part", F.col("user") % 8).repartition("part")
    parted.write.partitionBy("part").option("header", True).option("escape", '"').csv(path)
    return _digests(read_articles(spark, f"{path}/part=*/*.csv", pick="first"), F.col("user").cast("long"))


def csv_split(spark: SparkSession, folder: str) -> DataFrame:
    """Files that many tasks read side by side, and the place of every row in them."""
    path = _folder(spark, "csv")
    write_csv(_table(spark, folder).repartitionByRange(_files_for(spark, folder, 3), "user").sortWithinPartitions("user"), path)
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    share = max(1 << 17, _total(spark, path) // SPLITS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(share, _bytes(whole))))
    try:
        read = read_articles(spark, f"{path}/*.csv")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    placed = positions(read, key_order("row_key"), "place")
    found = _digests(placed, F.col("user").cast("long"))
    return found.join(placed.select(F.col("user").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place")), "doc_id")


def _bytes(size: str) -> int:
    """A size as Spark's settings write it."""
    number = size.lower().rstrip("b")
    unit = number.lstrip("0123456789")
    return int(number.removesuffix(unit)) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def zip_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as zip archives of several members and read again."""
    path = _folder(spark, "zip")
    write_zipped_csv(_table(spark, folder), path, 1 << 16)
    read = read_zipped_csv(spark, path, "title string, content string, category string, user long", 1 << 16)
    return _digests(read, F.col("user"))


def _corpus(spark: SparkSession, folder: str) -> str:
    """One text file per article, in a folder that is named after it: url, date, title, content."""
    path = _folder(spark, "corpus")
    text = F.concat_ws("\n", F.lit("http://x"), F.lit("2024-01-01"), "title", "content")
    write_corpus(articles(spark, folder).select("category", "doc_id", text.alias("value")), path, ["category", "doc_id"])
    return path


def corpus_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's name is the category of a corpus; here it holds the key of the article."""
    read = read_corpus(spark, _corpus(spark, folder))
    return read.select("category", F.md5("title").alias("title"), F.md5("content").alias("content"))


def corpus_body(spark: SparkSession, folder: str) -> DataFrame:
    read = read_corpus_body(spark, _corpus(spark, folder))
    return read.select("category", F.md5("text").alias("text"))


def _trained(spark: SparkSession, folder: str) -> tuple[bayes.TextModel, DataFrame]:
    docs = documents(spark, folder)
    parts = split(docs, "doc_id", 0.2, stratify="category")
    path = _folder(spark, "saved-model")
    bayes.fit(parts.filter("part = 'train'")).save(path)
    return bayes.load_model(spark, path), parts.filter("part = 'test'")


def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A model that was saved and loaded predicts what the trained one does."""
    model, test = _trained(spark, folder)
    return model.transform(test, "doc_id").select("doc_id", "label", F.round("score", 6).alias("score"))


def score_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """A small table without labels, scored by a saved model."""
    model, _ = _trained(spark, folder)
    return bayes.score_table(load(spark, folder, "benchmark"), model, "item_id").select("item_id", "predicted_category")

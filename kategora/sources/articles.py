"""Article tables in CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kategora.plans.storage import pinned, staged
from kategora.sources.records import fields_of, header_of, read_records

# Room for the rows of one file within a key.
FILE_BITS = 40

ARTICLES = "url string, title string, content string, category string, user string"

# Texts that stand for a missing value in article files.
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_articles(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str = ARTICLES,
    pick: str = "all",
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """Read CSV files with a header row; ``path`` may be a glob.

    Fields may hold line breaks and doubled quotes; a large file is read by many tasks. Empty fields and ``null_tokens`` are NULL.
    ``pick="first"`` reads only the first file by name. Columns are found by header name. ``row_key`` numbers the rows by file
    name and place in the file, however files are packed into tasks. The parsed rows are written to
    the shared folder once, so later passes neither parse again nor see other keys.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if pick == "first":
        paths = [first_input(spark, paths)]
    elif pick != "all":
        raise ValueError(f"pick must be all or first, not {pick!r}")
    wanted = T.StructType.fromDDL(schema)
    # Every column is read as text and chosen by its header name. Files with another header are
    # refused, not read in the wrong columns.
    records = read_records(spark, paths)
    names = header_of(records)
    rows = records.filter("number > 0").select("file", "number", F.inline(F.array(fields_of(F.col("text"), names))))
    raw = rows.toDF("_file", "_number", *names)
    present = [f for f in wanted.fields if f.name in names]
    cells = [
        F.when(~F.col(f.name).isin(*null_tokens), F.col(f.name)).cast(f.dataType).alias(f.name)
        if null_tokens
        else F.col(f.name).cast(f.dataType)
        for f in present
    ]
    others = [c for c in names if c not in {f.name for f in present}]
    placed = raw.select(*cells, *others, "_file", (F.col("_number") - 1).alias("_at"))
    return numbered(staged(placed, "articles"))


def numbered(rows: DataFrame) -> DataFrame:
    """``row_key`` from ``_file`` and ``_at``, which counts up by one along a file.

    Only one row for each file is grouped and ranked; the rows themselves stay where they are.
    """
    files = rows.groupBy("_file").agg(F.min("_at").alias("_first"))
    files = files.withColumn("_number", F.row_number().over(Window.orderBy("_file")) - 1)
    key = F.shiftleft(F.col("_number").cast("long"), FILE_BITS) + F.col("_at") - F.col("_first")
    joined = rows.join(pinned(files), "_file")
    return joined.withColumn("row_key", key).drop("_file", "_at", "_first", "_number")


def first_input(spark: SparkSession, paths: Sequence[str]) -> str:
    """First file by name among those the globs match."""
    names = spark.read.format("binaryFile").load(list(paths)).select(F.min("path"))
    return names.first()[0]


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write a folder of CSV part files with a header row."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)

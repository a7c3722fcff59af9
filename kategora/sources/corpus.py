"""Folder corpora: a directory per category, a text file per article."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.functions.text import drop_controls, let, strip
from kategora.plans.storage import staged
from kategora.sources.archives import open_store

LINE_BREAK = r"\r\n|\r|\n"
# Tasks that list the folders of one level, and the setting that says so.
LISTERS = 256
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Folders that a task lists and files that it reads, and the bytes of these.
LISTED, READ_FILES, READ_BYTES = 256, 1 << 14, 64 << 20
# Bytes and files that leave a task at once.
HELD_BYTES, HELD_FILES = 4 << 20, 1_000
# Stores whose folders the tasks list themselves.
STORES = ("file", "hdfs")
# Characters that a path of Spark's gives as numbers.
ILLEGAL = re.compile("[\\x00-\\x20\\x7f\"#%<>?\\[\\\\\\]^`{|}]")
# Fixed value: the folder of rows whose value is missing, as Spark's writers name it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _lines(value: Column) -> Column:
    """Lines of a text; a line break at the very end starts no further line."""
    return let(
        F.split(value, LINE_BREAK),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def _files(spark: SparkSession, root: str, exclude: Sequence[str]) -> DataFrame:
    files = _listed(spark, root)
    if files is None:
        files = _indexed(spark, root)
    path = F.split(F.col("path"), "/")
    named = files.select(
        _lines(F.col("value")).alias("lines"),
        F.url_decode(F.replace(F.element_at(path, -2), F.lit("+"), F.lit("%2B"))).alias("category"),
        "path",
        F.element_at(path, -1).alias("name"),
    )
    return named.filter(~F.col("name").isin(*exclude)) if exclude else named


def _indexed(spark: SparkSession, root: str) -> DataFrame:
    """``(value, path)`` by Spark's reader, for patterns and for stores that only Spark opens: the driver holds all files."""
    # Spark lists up to 10,000 folders by a task each, which costs more than the listing; the folders are listed at once, here.
    whole = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(LISTERS, int(whole))))
    try:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    finally:
        spark.conf.set(LISTING, whole)
    return files.select("value", F.col("_metadata.file_path").alias("path"))


def _listed(spark: SparkSession, root: str) -> DataFrame | None:
    """``(value, path)`` of a folder that the tasks list, level by level, and read: the driver counts files, it holds none.

    None for what is no such folder.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    if any(c in root for c in "{}[]*?\\"):
        return None
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (store.exists(hadoop) and store.getFileStatus(hadoop).isDirectory()):
        return None
    uri = store.makeQualified(hadoop).toUri()
    if uri.getScheme() not in STORES:
        return None
    host, start = uri.getAuthority(), uri.getPath()
    prefix = f"{uri.getScheme()}://{host}" if host else f"{uri.getScheme()}:"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_store(f"{prefix}/")
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(folder)) if _shown(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder.rstrip('/')}/{x.base_name}" for x in found], pa.string()),
                        pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()),
                        pa.array([x.size or 0 for x in found], pa.int64()),
                    ],
                    ["path", "folder", "size"],
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_store(f"{prefix}/")
        values, paths, size = [], [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                with files.open_input_stream(path) as file:
                    values.append(file.read())
                paths.append(prefix + ILLEGAL.sub(lambda c: f"%{ord(c[0]):02X}", path))
                size += len(values[-1])
                if size > HELD_BYTES or len(paths) >= HELD_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths)], ["value", "path"])
                    values, paths, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths)], ["value", "path"])

    folders = spark.createDataFrame([(start,)], "path string").coalesce(1)
    levels, many = [], 1
    while many:
        level = staged(folders.mapInArrow(look, "path string, folder boolean, size long"), "folders")
        levels.append(level.filter("not folder and size > 0").select("path", "size"))
        folders = level.filter("folder").select("path")
        many = folders.count()
        # Neighbours are dealt out, so that a folder with many others in it is listed by all.
        folders = folders.repartition(min(LISTERS, 1 + many // LISTED))
    files = reduce(DataFrame.unionByName, levels)
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    tasks = 1 + max(row["n"] // READ_FILES, (row["size"] or 0) // READ_BYTES)
    tasks = max(tasks, min(row["n"], spark.sparkContext.defaultParallelism))
    read_all = files.select("path").repartition(max(1, tasks)).mapInArrow(read, "value binary, path string")
    return read_all.select(F.col("value").cast("string").alias("value"), "path")


def _shown(file: fs.FileInfo) -> bool:
    """What Spark's reader would read: a folder or text file that is not hidden."""
    name = file.base_name
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden and (file.type == fs.FileType.Directory or name.endswith(".txt"))


def read_corpus(
    spark: SparkSession, root: str, exclude: Sequence[str] = ("LICENSE.txt",)
) -> DataFrame:
    """``(category, title, content, path)``: line 3 is the title, the lines after it the content."""
    rest = F.concat_ws("\n", F.slice("lines", 4, F.greatest(F.size("lines") - 3, F.lit(0))))
    return _files(spark, root, exclude).select(
        "category", strip(F.get("lines", F.lit(2))).alias("title"), strip(rest).alias("content"), "path"
    )


def read_corpus_body(
    spark: SparkSession, root: str, exclude: Sequence[str] = ("LICENSE.txt",)
) -> DataFrame:
    """``(category, text, path)``: from line 4 on, stripped, without blank lines and breaks."""
    rest = F.slice("lines", 4, F.greatest(F.size("lines") - 3, F.lit(0)))
    kept = F.filter(F.transform(rest, strip), lambda line: line != "")
    return _files(spark, root, exclude).select(
        "category", drop_controls(F.array_join(kept, "")).alias("text"), "path"
    )


def write_corpus(df: DataFrame, path: str, by: Sequence[str], value: str = "value") -> None:
    """Write texts into folders ``column=value`` nested as ``by`` says; rows of one task and folder share a file.

    The tasks write the files where they stay: Spark's own writer takes milliseconds for each of them, and
    the driver moves them one by one. A file is named by its task, so a task that runs again replaces it.
    ``path`` is one that executors can open, as for ``read_zipped_csv``.
    """
    names = [f"_{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(by, names)], F.col(value).cast("string").alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        last, file, written = None, None, 0
        for batch in batches:
            for *values, text in zip(*(c.to_pylist() for c in batch.columns)):
                if values != last:
                    if file:
                        file.close()
                    folder = posixpath.join(root, *[f"{c}={quote(v, safe=' ') if v else NO_VALUE}" for c, v in zip(by, values)])
                    store.create_dir(folder, recursive=True)
                    file, last = store.open_output_stream(f"{folder}/{name}"), values
                file.write(f"{text or ''}\n".encode("utf-8", "surrogatepass"))
                written += 1
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    rows.sortWithinPartitions(*names).mapInArrow(write, "written long").agg(F.sum("written")).collect()

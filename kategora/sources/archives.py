"""CSV files inside zip archives, as a data source of Spark.

The members of an archive are listed by its central directory, and each is an input partition of its
own (small ones share one), so an archive is read by many tasks. A task seeks to its members and
streams them: no archive and no member is ever held whole. A deflated member cannot be split.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK_ROWS = 10_000
SLICE_ROWS = 500
# Uncompressed bytes from which a member is a partition of its own.
SHARE_BYTES = 32 << 20
ORIGIN = ("archive", "member")
# Fixed value: the end record of an archive, which an archive without members begins with.
END_RECORD = b"PK\x05\x06"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path within it; without a scheme it is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives_of(path: str) -> list[str]:
    """Paths of the archives: all ``.zip`` of a folder, those a pattern matches, or the one named."""
    store, name = open_store(path)
    folder = name.rstrip("/")
    if not any(c in name for c in "*?["):
        if store.get_file_info(folder).type == fs.FileType.File:
            return [folder]
        pattern = f"{folder}/*.zip"
    else:
        pattern = name
        folder = name[: min(name.index(c) for c in "*?[" if c in name)].rsplit("/", 1)[0]
    found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, pattern) and f.path.count("/") == pattern.count("/"))


@dataclass
class Members(InputPartition):
    archive: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, share_bytes: int = SHARE_BYTES):
        self.path, self.schema, self.share_bytes = path, schema, share_bytes

    def partitions(self) -> list[Members]:
        store, _ = open_store(self.path)
        found = []
        for name in archives_of(self.path):
            with store.open_input_file(name) as file:
                # ``zipfile`` seeks before the start of so short a file, which Arrow's files refuse.
                if file.read(len(END_RECORD)) == END_RECORD:
                    continue
                file.seek(0)
                room = 0
                for member in zipfile.ZipFile(file).infolist():
                    if not member.filename.endswith(".csv"):
                        continue
                    if room < member.file_size or not found or found[-1].archive != name:
                        found.append(Members(name, []))
                        room = self.share_bytes
                    found[-1].names.append(member.filename)
                    room -= member.file_size
        return found or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        store, _ = open_store(self.path)
        fields = [f.name for f in self.schema.fields]
        kinds = pa.schema([(n, pa.string()) for n in fields])
        with store.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                origin = dict(zip(ORIGIN, (partition.archive, name)))
                with archive.open(name) as member:
                    for rows in pd.read_csv(member, dtype=str, chunksize=CHUNK_ROWS):
                        own = {c: v for c, v in origin.items() if c in fields}
                        whole = rows.reindex(columns=[c for c in fields if c not in own]).assign(**own)[fields]
                        yield from pa.Table.from_pandas(whole, schema=kinds, preserve_index=False).to_batches()


@dataclass
class Written(WriterCommitMessage):
    path: str


class ZipWriter(DataSourceArrowWriter):
    """One archive for each task; what is not part of the committed result is deleted."""

    def __init__(self, path: str, member_bytes: int):
        self.path, self.member_bytes = path, member_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{name}.tmp") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            member, size, number = None, 0, 0
            for batch in (b.slice(at, SLICE_ROWS) for b in iterator for at in range(0, len(b), SLICE_ROWS)):
                if member is None or size >= self.member_bytes:
                    if member:
                        member.close()
                    member, size, number = archive.open(f"rows-{number}.csv", "w", force_zip64=True), 0, number + 1
                data = io.BytesIO()
                pyarrow.csv.write_csv(batch, data, pyarrow.csv.WriteOptions(include_header=not size))
                size += member.write(data.getvalue())
            if member:
                member.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            if message:
                store.move(f"{message.path}.tmp", f"{message.path}.zip")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)
        for message in messages:
            if message:
                store.delete_file(f"{message.path}.tmp")


class ZippedCsv(DataSource):
    """``format("zipped_csv")``; all columns are text."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: T.StructType) -> ZipReader:
        return ZipReader(self.options["path"], schema, int(self.options.get("sharebytes", SHARE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], int(self.options.get("memberbytes", SHARE_BYTES)))


def read_zipped_csv(spark: SparkSession, path: str, schema: str, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Rows of all members ending in ``.csv`` of the archives matched by ``path``.

    The result has the columns of ``schema`` (missing ones are NULL) plus ``archive`` and ``member``. Every
    large member is a task's, whatever archive it lies in; those below ``share_bytes`` share one. ``path``
    is one that executors can open: a shared folder, or a store that Arrow knows by its scheme.
    """
    spark.dataSource.register(ZippedCsv)
    wanted = T.StructType.fromDDL(schema)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in (*wanted.fieldNames(), *ORIGIN)])
    rows = spark.read.format("zipped_csv").schema(texts).option("sharebytes", share_bytes).load(path)
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in wanted.fields], *ORIGIN)


def write_zipped_csv(df: DataFrame, path: str, member_bytes: int = SHARE_BYTES) -> None:
    """Write a folder of zip archives, one for each task, with members of about ``member_bytes``."""
    df.sparkSession.dataSource.register(ZippedCsv)
    texts = df.select(*[df[c].cast("string").alias(c) for c in df.columns])
    texts.write.format("zipped_csv").mode("append").option("memberbytes", member_bytes).save(path)

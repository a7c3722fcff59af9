"""CSV records that may hold line breaks, read from one file by many tasks.

A task that starts in the middle of a file cannot tell whether it is inside a quoted field. So every
split first counts its quotes, and the records that start in it for either case; sums over the splits
before it tell in which state it begins and how many records precede it. Then the splits are cut
into records side by side. Only records that lie across a border are put together by a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kategora.plans.storage import SMALL_ROWS, staged

QUOTE = '"'


def split_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, block, at, line``: physical lines, and the split (its first byte) in which they start."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that belong to one split."""
    if not batch.num_rows:
        return
    changes = np.ones(batch.num_rows, bool)
    for name in ("file", "block"):
        column = batch.column(name)
        same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        changes[1:] = ~same.astype(bool) if name == "file" else changes[1:] | ~same.astype(bool)
    starts = np.flatnonzero(changes).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _states(line: pa.Array, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Whether each line starts inside quotes, whether it is blank, and the state behind the last one."""
    quotes = pc.count_substring(line, QUOTE).to_numpy(zero_copy_only=False)
    after = (np.cumsum(quotes) + inside) % 2
    before = np.r_[inside, after[:-1]].astype(bool)
    blank = pc.is_in(line, pa.array(["", "\r"])).to_numpy(zero_copy_only=False).astype(bool)
    return before, blank, int(after[-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each split (their number modulo 2), and its records if it starts outside or inside quotes."""
    for batch in batches:
        rows = []
        for run in _runs(batch):
            before, blank, state = _states(run.column("line"), 0)
            outside = int((~before & ~blank).sum())
            # ``before`` holds for a start outside quotes; inside, every line is in the other state.
            rows.append((run.column("file")[0].as_py(), run.column("block")[0].as_py(), run.column("at")[0].as_py(), state, outside, int((before & ~blank).sum())))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "at", "odd", "outside", "inside"])


def split_states(lines: DataFrame) -> DataFrame:
    """``file, block, state, number``: state (1: inside quotes) at the start of each split, and the records that start before it."""
    parts = staged(lines.mapInArrow(_count, "file string, block long, at long, odd int, outside long, inside long"), "quote-counts")
    # A split is counted batch by batch, each from state 0; the states are put in a chain over its file.
    order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2
    chained = parts.withColumn("state", state.cast("int"))
    chained = chained.withColumn("records", F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside")))
    chained = chained.withColumn("number", F.coalesce(F.sum("records").over(order), F.lit(0)))
    first = F.min(F.struct("at", "state", "number"))
    states = chained.groupBy("file", "block").agg(first.alias("first")).select("file", "block", "first.state", "first.number")
    return staged(states, "split-states")


class _Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, run: pa.RecordBatch):
        self.file, self.block = run.column("file")[0], run.column("block")[0].as_py()
        self.state, self.number = run.column("state")[0].as_py(), run.column("number")[0].as_py()
        # Lines of the record that is open; one from an earlier split is a fragment.
        self.open: list[pa.Array] = []
        self.fragment = bool(self.state)

    def batch(self, numbers: list[int], texts: pa.Array, part: int | None) -> pa.RecordBatch:
        n = len(texts)
        arrays = [pa.array([self.file.as_py()] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([part] * n, pa.int64()), texts]
        return pa.RecordBatch.from_arrays(arrays, ["file", "number", "part", "text"])

    def joined(self) -> pa.Array:
        lines = pa.concat_arrays(self.open)
        return pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")

    def closed(self, cut: bool) -> Iterator[pa.RecordBatch]:
        """The open record; ``cut`` if its end is in another split."""
        if self.open:
            number = self.number - 1
            yield self.batch([number], self.joined(), self.block if cut or self.fragment else None)
        self.open, self.fragment = [], False

    def take(self, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        line = run.column("line")
        before, blank, self.state = _states(line, self.state)
        keep = before | ~blank
        line, starts = line.filter(pa.array(keep)), np.flatnonzero(~before[keep]).tolist()
        head = starts[0] if starts else len(line)
        if head:
            self.open.append(line.slice(0, head))
        if not starts:
            return
        yield from self.closed(False)
        if len(starts) > 1:
            whole = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), line.slice(0, starts[-1]))
            numbers = range(self.number, self.number + len(starts) - 1)
            yield self.batch(list(numbers), pc.binary_join(whole, "\n"), None)
        self.number += len(starts)
        self.open = [line.slice(starts[-1])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        for run in _runs(batch):
            if cutter is None or (cutter.file, cutter.block) != (run.column("file")[0], run.column("block")[0].as_py()):
                if cutter:
                    yield from cutter.closed(bool(cutter.state))
                cutter = _Cutter(run)
            yield from cutter.take(run)
    if cutter:
        yield from cutter.closed(bool(cutter.state))


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, number, text`` of all records of CSV files, numbered from 0 (the header) along each file.

    A field with a line break, comma or quote is in quotes, its own quotes doubled. Blank lines between
    records are none. Compressed files cannot be split: each is one task's.
    """
    lines = split_lines(spark, paths)
    states = split_states(lines)
    # One row per split. A broadcast keeps the lines in their order; many splits are joined by shuffle and sorted again.
    small = states.count() <= SMALL_ROWS
    tagged = lines.join(F.broadcast(states) if small else states, ["file", "block"])
    if not small:
        tagged = tagged.sortWithinPartitions("file", "block", "at")
    pieces = staged(tagged.mapInArrow(_cut, "file string, number long, part long, text string"), "records")
    whole = pieces.filter("part is null").select("file", "number", "text")
    across = pieces.filter("part is not null").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("parts"))
    return whole.unionByName(across.select("file", "number", F.array_join("parts.text", "\n").alias("text")))


def header_of(records: DataFrame) -> list[str]:
    """Column names of the header row, which all files have to share."""
    found = records.filter("number = 0").select(F.btrim("text", F.lit("\r\ufeff")).alias("text")).distinct().limit(2).collect()
    names = {tuple(next(csv.reader([r["text"]]))) for r in found}
    if len(names) > 1:
        raise ValueError(f"files with different headers: {sorted(names)}")
    return list(names.pop()) if names else []


def fields_of(text: Column, names: Sequence[str]) -> Column:
    """The fields of a record as a struct of texts; empty fields are NULL."""
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    line = F.regexp_replace(text, "\r$", "")
    return F.from_csv(line, schema, {"escape": QUOTE})

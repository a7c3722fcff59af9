"""Terms of many documents at once: one row per chunk of documents and term, instead of one per document and term.

A task cuts its rows into chunks of a bounded number of words. Inside a chunk words are numbers, so counting is
one sort of numbers, and a term's text leaves the task once per chunk, with the documents it is in as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kategora.functions.text import tokens

# Words that one chunk holds; a longer document is a chunk by itself.
CHUNK_WORDS = 1 << 21
# Rows that leave a task at once.
BATCH_ROWS = 1 << 16


@dataclass
class Counted:
    """N-grams of one length in a chunk: ``term[i]`` is in the documents ``doc[starts[i]:starts[i + 1]]``, ``tf`` times each."""

    term: pa.Array
    starts: np.ndarray
    doc: np.ndarray
    tf: np.ndarray


def _word_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(batch["_words"]), 0).to_numpy(zero_copy_only=False)


def _chunks(
    batches: Iterator[pa.RecordBatch], numbers: Callable[[pa.RecordBatch], np.ndarray] = _word_numbers, most: int | None = None
) -> Iterator[pa.Table]:
    """Rows put together until they hold ``most`` of what ``numbers`` counts: ``CHUNK_WORDS`` words of the last column ``_words``."""
    held, words, most = [], 0, most or CHUNK_WORDS
    for batch in batches:
        sizes = numbers(batch)
        # A row counts as one word more, so that rows without words fill a chunk, too.
        total = np.r_[0, np.cumsum(sizes.astype(np.int64) + 1)]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + most - words, "right")) - 1
            end = max(end, at if held else at + 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                words += int(total[end] - total[at])
            if end < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, words = [], 0
            at = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(chunk: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """All words of a chunk one after the other, and the row of each."""
    lists = chunk["_words"].combine_chunks() if isinstance(chunk["_words"], pa.ChunkedArray) else chunk["_words"]
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def counted(chunk: pa.Table, lo: int, hi: int, ordered: bool = False) -> Iterator[Counted]:
    """Terms of ``lo`` to ``hi`` words of a chunk, one length after the other; with ``ordered`` in the order of their words."""
    flat, doc = _words(chunk)
    if not len(flat):
        return
    coded = flat.dictionary_encode()
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if ordered:
        order = pc.sort_indices(known)
        known, code = known.take(order), np.argsort(order.to_numpy())[code]
    documents, spelled = chunk.num_rows, known
    # Number of the n-gram that starts at a word; ``place`` are the words at which one of this length starts.
    gram, place = code, np.arange(len(code))
    for n in range(1, hi + 1):
        if n > 1:
            last = place + n - 1
            fits = last < len(doc)
            fits[fits] = doc[place[fits]] == doc[last[fits]]
            place, gram = place[fits], gram[fits]
            if not len(place):
                return
            pair = gram * len(known) + code[place + n - 1]
        else:
            pair = gram
        if n >= lo:
            found, tf = np.unique(pair * documents + doc[place], return_counts=True)
            each = found // documents
            starts = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
            distinct = each[starts]
            yield Counted(_spelled(spelled, known, distinct, n), np.r_[starts, len(each)], found % documents, tf)
        if 1 < n < hi:
            distinct, gram = np.unique(pair, return_inverse=True)
            spelled = _spelled(spelled, known, distinct, n)


def _spelled(shorter: pa.Array, known: pa.Array, pair: np.ndarray, n: int) -> pa.Array:
    if n == 1:
        return known.take(pa.array(pair))
    first, last = np.divmod(pair, len(known))
    return pc.binary_join_element_wise(shorter.take(pa.array(first)), known.take(pa.array(last)), " ")


def _column(chunk: pa.Table, name: str) -> pa.Array:
    column = chunk[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _batches(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    for at in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(at, BATCH_ROWS)


def doc_terms(
    df: DataFrame, keep: Sequence[str], text: str = "text", lo: int = 1, hi: int = 1, outer: bool = False
) -> DataFrame:
    """``(term, keep..., tf)``, the latter arrays: the rows of ``term_freq`` of a chunk of documents, by term.

    There is no shuffle. With ``outer`` documents without terms are held by rows whose term is NULL.
    """
    rows = df.select(*keep, tokens(F.col(text)).alias("_words"))
    kinds = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in keep]
    schema = T.StructType([T.StructField("term", T.StringType()), *kinds, T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            with_terms = np.zeros(chunk.num_rows, bool)
            for c in counted(chunk, lo, hi):
                with_terms[c.doc] = True
                arrays = [_lists(_column(chunk, k).take(pa.array(c.doc)), c.starts) for k in keep]
                arrays.append(_lists(pa.array(c.tf, pa.int32()), c.starts))
                yield from _batches([c.term, *arrays], ["term", *keep, "tf"])
            bare = np.flatnonzero(~with_terms)
            if outer and len(bare):
                starts = np.array([0, len(bare)])
                arrays = [_lists(_column(chunk, k).take(pa.array(bare)), starts) for k in keep]
                arrays.append(_lists(pa.nulls(len(bare), pa.int32()), starts))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *arrays], names=["term", *keep, "tf"])

    return rows.mapInArrow(run, schema)


def unnested(nested: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row for each entry of the columns ``arrays``, beside all other columns."""
    rest = [c for c in nested.columns if c not in arrays]
    return nested.select(*rest, F.inline(F.arrays_zip(*arrays)))


def token_places(
    df: DataFrame, keep: Sequence[str], words: Column, at: str = "_at", token: str = "token"
) -> DataFrame:
    """``(token, keep..., at)``, the latter arrays: where the ``words`` of a chunk of rows are, by word.

    Rows without words, and words that are NULL, are held by rows whose token is NULL; a row without words is at NULL.
    """
    rows = df.select(*keep, words.alias("_words"))
    kinds = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in keep]
    schema = T.StructType([T.StructField(token, T.StringType()), *kinds, T.StructField(at, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            flat, row = _words(chunk)
            bare = np.flatnonzero(np.bincount(row, minlength=chunk.num_rows) == 0)
            if len(flat):
                coded = flat.dictionary_encode("encode")
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                arrays = [_lists(_column(chunk, k).take(pa.array(row[order])), np.r_[starts, len(code)]) for k in keep]
                arrays.append(_lists(pa.array(place[order], pa.int32()), np.r_[starts, len(code)]))
                named = coded.dictionary.take(pa.array(code[order][starts]))
                yield from _batches([named, *arrays], [token, *keep, at])
            if len(bare):
                starts = np.array([0, len(bare)])
                arrays = [_lists(_column(chunk, k).take(pa.array(bare)), starts) for k in keep]
                arrays.append(_lists(pa.nulls(len(bare), pa.int32()), starts))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *arrays], names=[token, *keep, at])

    return rows.mapInArrow(run, schema)


def class_shares(docs: DataFrame, classes: int, text: str = "text", lo: int = 1, hi: int = 1) -> DataFrame:
    """``(term, df, used, s0, s1, ...)`` for each chunk of ``docs(label, norm, text)``.

    ``df`` counts the documents with the term, ``used`` those that have a ``norm``; ``s`` are the sums of
    ``tf / norm`` of each class.
    """
    rows = docs.select("label", "norm", tokens(F.col(text)).alias("_words"))
    names = [f"s{c}" for c in range(classes)]
    schema = "term string, df long, used long, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            label = _column(chunk, "label").to_numpy(zero_copy_only=False)
            norm = pc.fill_null(_column(chunk, "norm"), np.inf).to_numpy(zero_copy_only=False)
            for c in counted(chunk, lo, hi):
                step = max(1, min(BATCH_ROWS, (1 << 21) // classes))
                for at in range(0, len(c.term), step):
                    starts = c.starts[at : at + step + 1]
                    doc, tf = c.doc[starts[0] : starts[-1]], c.tf[starts[0] : starts[-1]]
                    sizes = np.diff(starts)
                    term = np.repeat(np.arange(len(sizes)), sizes)
                    cells = np.bincount(term * classes + label[doc], tf / norm[doc], len(sizes) * classes)
                    used = np.bincount(term, np.isfinite(norm[doc]), len(sizes)).astype(np.int64)
                    sums = cells.reshape(-1, classes).T
                    yield pa.RecordBatch.from_arrays(
                        [c.term.slice(at, step), pa.array(sizes, pa.int64()), pa.array(used), *[pa.array(np.ascontiguousarray(s)) for s in sums]],
                        names=["term", "df", "used", *names],
                    )

    return rows.mapInArrow(run, schema)

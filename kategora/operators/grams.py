"""Counts of all n-grams of a table from one shuffled row per word.

An n-gram is the beginning of the run of at most ``hi`` words that starts at the same word. So only these runs
are shuffled, by their first two words, and sorted: the uses of every n-gram are then neighbours, and the sums
of all lengths come out of one pass over the sorted runs. Within a document the runs are sorted, too: the
words that a run shares with the one before it tell which of its n-grams the document had already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kategora.functions.text import tokens

# Words that one step of a task holds as numbers.
CHUNK_WORDS = 1 << 20
RUNS = "run string, shared int, n long"


def gram_counts(df: DataFrame, text: str = "text", lo: int = 1, hi: int = 1) -> DataFrame:
    """``(term, docs, uses)`` of all n-grams of ``lo`` to ``hi`` words: documents they are in, and occurrences.

    Every row is a document. NULL and empty texts have no n-grams.
    """
    parts = []
    if lo == 1:
        each = df.select(tokens(F.col(text)).alias("words")).mapInArrow(_words, "term string, docs long, uses long")
        parts.append(each.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")))
    if hi > 1:
        found = _sorted_runs(df, text, max(lo, 2), hi)
        parts.append(found.mapInArrow(_spelled(max(lo, 2), hi), "term string, docs long, uses long"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def gram_histogram(df: DataFrame, text: str = "text", lo: int = 1, hi: int = 1) -> DataFrame:
    """``(docs, terms, uses)``: how many n-grams are found in how many documents, and how often."""
    parts = []
    if lo == 1:
        parts.append(gram_counts(df, text).select("docs", F.lit(1).cast("long").alias("terms"), "uses"))
    if hi > 1:
        found = _sorted_runs(df, text, max(lo, 2), hi)
        parts.append(found.mapInArrow(_tallied(max(lo, 2), hi), "docs long, terms long, uses long"))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.groupBy("docs").agg(F.sum("terms").alias("terms"), F.sum("uses").alias("uses"))


def _sorted_runs(df: DataFrame, text: str, lo: int, hi: int) -> DataFrame:
    runs = df.select(tokens(F.col(text)).alias("words")).mapInArrow(_runs(lo, hi), RUNS)
    # A space is smaller than any sign of a word, so texts in order are words in order.
    return runs.repartition(F.substring_index("run", " ", 2)).sortWithinPartitions("run")


def _chunks(words: pa.Array) -> Iterator[pa.Array]:
    """Documents in parts of about ``CHUNK_WORDS`` words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // CHUNK_WORDS
    for a, b in zip(starts := np.flatnonzero(np.diff(part, prepend=-1)).tolist(), [*starts[1:], len(sizes)]):
        yield words.slice(a, b - a)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and uses of each word, added up over the documents of a chunk."""
    for batch in batches:
        for words in _chunks(batch.column("words")) if batch.num_rows else ():
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            ids, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + ids)
            docs = np.bincount(once % max(n, 1), minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(docs), pa.array(np.bincount(ids, minlength=n))], ["term", "docs", "uses"])


def _runs(lo: int, hi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _chunks(batch.column("words")) if batch.num_rows else ():
                yield _chunk_runs(words, lo, hi)

    return run


def _chunk_runs(words: pa.Array, lo: int, hi: int) -> pa.RecordBatch:
    """Runs of at least ``lo`` words with the words shared with the run before in their document, and how many are alike."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    # Number 0 fills the ends of documents, so that no run goes on into the next.
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) * hi, sizes)
    ids = np.zeros(sizes.sum() + (len(sizes) + 1) * hi, np.int64)
    ids[at] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    length = np.minimum(np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum()), hi)
    # Order of the runs of all places, put together from the orders of shorter ones.
    rank, size = ids, 1
    while size < hi:
        step = min(size, hi - size)
        pair = rank * (rank.max(initial=0) + 1)
        pair[:-step] += rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    keep = np.flatnonzero(length >= lo)
    at, doc, length = at[keep], doc[keep], length[keep]
    order = np.lexsort((rank[at], doc))
    at, doc, length = at[order], doc[order], length[order]
    same, shared = doc[1:] == doc[:-1], np.zeros(len(at), np.int64)
    for k in range(hi):
        same = same & (ids[at[1:] + k] == ids[at[:-1] + k]) & (length[1:] > k)
        shared[1:] += same
    first, n = np.unique(rank[at] * (hi + 1) + shared, return_index=True, return_counts=True)[1:]
    at, length = at[first], length[first]
    places = np.repeat(at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    spelled = coded.dictionary.take(pa.array(ids[places] - 1))
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), spelled)
    return pa.RecordBatch.from_arrays(
        [pc.binary_join(runs, " ").cast(pa.string()), pa.array(shared[first], pa.int32()), pa.array(n, pa.int64())], ["run", "shared", "n"]
    )


def _grouped(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the finished n-grams: runs as word lists, places where an n-gram begins, its documents and uses.

    The sums of the n-grams that the last run of a batch begins with are carried on by that run.
    """
    last, carried = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("run")
        shared, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shared", "n"))
        if last is not None:
            text = pa.concat_arrays([pa.array([last], text.type), text])
            shared, n = np.r_[hi, shared], np.r_[0, n]
        words = pc.split_pattern(text, " ")
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(length) - length
        ids = np.r_[words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False), np.zeros(hi, np.int64)]
        same, alike = np.ones(len(length) - 1, bool), np.zeros(len(length), np.int64)
        for k in range(hi):
            same = same & (np.minimum(length[1:], length[:-1]) > k) & (ids[begin[1:] + k] == ids[begin[:-1] + k])
            alike[1:] += same
        open_sums = {}
        for k in range(lo, hi + 1):
            there = np.flatnonzero(length >= k)
            if not len(there):
                continue
            uses, docs = n[there], np.where(shared[there] < k, n[there], 0)
            if there[0] == 0 and k in carried:
                docs[0], uses[0] = carried[k]
            opens = alike[there] < k
            opens[0] = True
            opens = np.flatnonzero(opens)
            uses, docs = np.add.reduceat(uses, opens), np.add.reduceat(docs, opens)
            starts = there[opens]
            if length[-1] >= k:
                open_sums[k] = docs[-1], uses[-1]
                uses, docs, starts = uses[:-1], docs[:-1], starts[:-1]
            yield k, words, starts, docs, uses
        last, carried = text[-1].as_py(), open_sums
    if last is not None:
        words = pa.array([last.split(" ")], pa.list_(pa.string()))
        for k, (docs, uses) in carried.items():
            yield k, words, np.array([0]), np.array([docs]), np.array([uses])


def _spelled(lo: int, hi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, words, starts, docs, uses in _grouped(batches, lo, hi):
            heads = pc.list_slice(words.take(pa.array(starts)), 0, k)
            yield pa.RecordBatch.from_arrays([pc.binary_join(heads, " ").cast(pa.string()), pa.array(docs), pa.array(uses)], ["term", "docs", "uses"])

    return run


def _tallied(lo: int, hi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, docs, uses in _grouped(batches, lo, hi):
            found, place, terms = np.unique(docs, return_inverse=True, return_counts=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, place, uses)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(terms), pa.array(sums)], ["docs", "terms", "uses"])

    return run

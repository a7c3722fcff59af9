"""Byte-level BPE: words found by Spark, encoded in Arrow batches; decoding joins the pieces.

A task encodes the distinct words of a batch, whatever the number of their occurrences, and puts the
ids back in their places. All words are merged together: a round merges, in each of them, the
leftmost pair of lowest rank, until no pair has a rank. So the steps of Python go by the length of
the words, not by their number; a very long word is merged by itself, with a queue of its pairs.

The vocabulary is sent to the tasks as arrays. A task keeps the words that were frequent in its
batches (at most ``FREQUENT``), which only saves work. Nothing is shuffled or fetched.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENT = 1 << 17
NO_RANK = 2**31 - 1
# Bytes of a word that is merged by itself, bytes of the words merged together, words put back together.
LONG = 512
BLOCK = 1 << 16
SLICE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a piece in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def words(text: Column, pattern: str) -> Column:
    """Every match of ``pattern``, with Unicode white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def spans(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """``(from, to)`` of neighbours, given where each ends, that take some ``size`` together."""
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)], strict=True) if len(ends) else ()


def gathered(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` ids from each start on, one after the other."""
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return ids[shift + np.arange(len(shift))]


class Merges:
    """Ranks of all pairs of pieces. A piece is told by its rank; a byte that is no piece has a number behind all ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks.get(bytes([b]), self.size + b) for b in range(256)], np.int64)
        number = {bytes([b]): int(n) for b, n in enumerate(self.bytes)} | ranks
        halves = ((p[:i], p[i:], rank) for p, rank in ranks.items() for i in range(1, len(p)))
        pairs = sorted((self.key(number[a], number[b]), rank) for a, b, rank in halves if a in number and b in number)
        # The last key is that of no pair.
        self.keys, self.ranks = np.array([*pairs, (2**63 - 1, NO_RANK)], np.int64).T.copy()

    def key(self, left, right):
        return left * (self.size + 256) + right

    @cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_RANK`` for what is no piece together."""
        key = self.key(left, right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged(self, parts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, start, count`` of words, given the pieces of all their bytes and their lengths (1 at least)."""
        start, count = np.zeros((2, len(lengths)), np.int64)
        word, out, given = np.arange(len(lengths)), [], 0
        ranks = np.append(self.pairs(parts[:-1], parts[1:]), NO_RANK)
        ranks[np.cumsum(lengths) - 1] = NO_RANK
        while len(word):
            first = np.cumsum(lengths) - lengths
            low = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), first)
            best, at = low >> 32, low & 0xFFFFFFFF
            live = best < NO_RANK
            if not live.all():
                done, inside = ~live, np.repeat(live, lengths)
                out.append(parts[~inside])
                count[word[done]] = lengths[done]
                start[word[done]] = given + np.cumsum(lengths[done]) - lengths[done]
                given += len(out[-1])
                at = (at - first)[live]
                parts, ranks, lengths, word, best = parts[inside], ranks[inside], lengths[live], word[live], best[live]
                at += np.cumsum(lengths) - lengths
            parts[at] = best
            kept = np.ones(len(parts), bool)
            kept[at + 1] = False
            parts, ranks, lengths = parts[kept], ranks[kept], lengths - 1
            # One part is gone from each word; only the ranks beside the new one change.
            at -= np.arange(len(at))
            last = np.cumsum(lengths) - 1
            ranks[at] = NO_RANK
            right, left = at[at < last], at[at > last - lengths + 1]
            ranks[right] = self.pairs(parts[right], parts[right + 1])
            ranks[left - 1] = self.pairs(parts[left - 1], parts[left])
        return np.concatenate([*out, np.zeros(0, np.int64)]), start, count

    def merged_long(self, raw: np.ndarray) -> list[int]:
        """Ids of one word; the same merges, the next one from a queue of ``(rank, place)``."""
        parts, n = raw.tolist(), len(raw)
        ranks = [*self.pairs(raw[:-1], raw[1:]).tolist(), NO_RANK]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rank, i) for i, rank in enumerate(ranks) if rank < NO_RANK]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            if ranks[i] != rank:  # one of its parts was merged with another
                continue
            gone = after[i]
            parts[i], ranks[gone], after[i] = rank, NO_RANK, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    ranks[k] = self.table.get(self.key(parts[k], parts[after[k]]), NO_RANK) if after[k] < n else NO_RANK
                    if ranks[k] < NO_RANK:
                        heappush(queue, (ranks[k], k))
        ids, i = [], 0
        while i < n:
            ids.append(parts[i])
            i = after[i]
        return ids


class Known:
    """Words (binary) with their encodings: ``count`` ids from ``start`` on."""

    def __init__(self, words: pa.Array, ids: np.ndarray, start: np.ndarray, count: np.ndarray):
        self.words, self.ids, self.start, self.count = words, ids, start, count

    def encoded(self, words: pa.Array, merges: Merges) -> tuple[Known, np.ndarray]:
        """The encodings of distinct words, and the places of those that had to be merged."""
        words = words.cast(pa.binary())
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        start, count = np.where(known < 0, 0, self.start[known]), np.where(known < 0, 0, self.count[known])
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        new = np.flatnonzero((known < 0) & (sizes > 0))
        # Words of about one length take as many rounds.
        new = new[np.argsort(sizes[new], kind="stable")]
        sizes, data = sizes[new], words.take(pa.array(new))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        ids, given = [self.ids], len(self.ids)
        short = int(np.searchsorted(sizes, LONG, "right"))
        for a, b in spans(ends[:short], BLOCK):
            parts = merges.bytes[raw[ends[a] - sizes[a] : ends[b - 1]]]
            found, first, n = merges.merged(parts, sizes[a:b])
            start[new[a:b]], count[new[a:b]] = given + first, n
            ids.append(np.where(found < merges.size, found, NO_RANK))
            given += len(found)
        for i in range(short, len(new)):
            found = np.array(merges.merged_long(merges.bytes[raw[ends[i] - sizes[i] : ends[i]]]))
            start[new[i]], count[new[i]] = given, len(found)
            ids.append(np.where(found < merges.size, found, NO_RANK))
            given += len(found)
        return Known(words, np.concatenate(ids), start, count), new

    def joined(self, other: Known, places: np.ndarray) -> Known:
        """With some words of another one."""
        count = other.count[places]
        ids = np.r_[self.ids, gathered(other.ids, other.start[places], count)]
        start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        chosen = other.words.take(pa.array(places))
        return Known(pa.concat_arrays([self.words, chosen]), ids, start, np.r_[self.count, count])


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.merges = Merges(ranks)
        whole = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.vocabulary = Known(pa.array(list(ranks), pa.binary()), whole, np.arange(len(ranks)), np.ones(len(ranks), np.int64))
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"), ensure_ascii=False)), "array<string>")

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
        """``key, ids`` (array of int) for every row, the whole text and no special tokens.

        NULL and empty texts have no ids; NULL keys and repeated rows pass through; other columns
        are ignored; an empty table gives an empty result. Equal to encoding each match of the
        pattern by itself.
        """
        merges, vocabulary = self.merges, self.vocabulary
        rows = docs.select(F.col(key).alias("key"), words(F.col(text), self.pattern).alias("words"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, left = vocabulary, frequent
            for batch in batches:
                lists = batch.column("words")
                coded = lists.flatten().dictionary_encode()
                codes = coded.indices.to_numpy()
                found, new = known.encoded(coded.dictionary, merges)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets -= offsets[0]
                for a, b in spans(offsets[1:], SLICE):
                    part = codes[offsets[a] : offsets[b]]
                    count = found.count[part]
                    ids = gathered(found.ids, found.start[part], count).astype(np.int32)
                    ends = np.r_[0, np.cumsum(count)][offsets[a : b + 1] - offsets[a]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(a, b - a), pa.ListArray.from_arrays(ends, ids)], ["key", "ids"]
                    )
                if left:
                    times = np.bincount(codes, minlength=len(found.words))[new]
                    again = (times > 1) & (pc.binary_length(found.words).to_numpy()[new] <= LONG)
                    new = new[again][np.argsort(-times[again], kind="stable")][:left]
                    known, left = known.joined(found, new), left - len(new)

        schema = T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
        return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids: the pieces one after the other."""
        pieces = F.transform(ids, lambda i: F.get(self.pieces, i))
        return F.encode(F.array_join(pieces, ""), "ISO-8859-1")


def digests(encoded: DataFrame, bpe: ByteBpe, key: str = "doc_id") -> DataFrame:
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )

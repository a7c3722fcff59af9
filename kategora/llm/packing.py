"""Packing documents into sequences of bounded length by bin completion.

Only the number of pieces of each length matters for the plan, and there are at most as many
lengths as a sequence has tokens. So Spark makes a histogram, the driver solves it (its work and
memory depend on the sequence length, not on the documents), and every piece finds its place from
its length and its rank among pieces of that length. Ranks come from counts per length and bucket,
so a length that a third of the pieces share is never ranked in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kategora.plans.storage import staged

CAPACITY = 2048
END = 0
# Steps of the whole search, steps of the search for the fillings of one sequence, and how many of them are tried.
STEPS = 600_000
NODE_STEPS = 50
FILLING_STEPS = 400
WIDTH = 64
# Pieces in a bucket that is ranked by one task.
BUCKET_ROWS = 50_000
BUCKETS = 64
CHUNK = 1 << 20
# Rows whose texts are Python strings at the same time.
ROWS = 256
# Bytes of words, and of their ids, that an encoder keeps; with Python's own some five to ten times that.
CACHED = 8 << 20
# White space for Python that is none for the tokenizer.
ODD = "\x1c\x1d\x1e\x1f"
# Stands between words that are encoded together; words that contain it are encoded alone.
BREAK = "\x01"
# Letters that end with a mark once they are normalised and lower-cased; a stop after a mark is one piece with it.
MARKED = (
    r"\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69"
    r"\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e"
)
# Stops and commas that end a word are pieces of their own for the tokenizer if a letter or digit precedes them.
ENDING = re.compile(rf"[.,](?<=[^\W_{MARKED}].)[.,]*(?!\S)")


# ``(copies, lengths)`` of sequences that are filled alike.
Plan = list[tuple[int, tuple[int, ...]]]


@dataclass(frozen=True)
class Pattern:
    """``copies`` sequences from number ``first`` on, each with ``(length, how often)`` in this order."""

    first: int
    copies: int
    items: tuple[tuple[int, int], ...]


def dominated(chosen: list[int], counts: np.ndarray, there: int, room: int) -> bool:
    """Whether a longer piece that is left could replace some of the chosen ones within the same sequence.

    A solution with ``chosen`` then is never better than one with that piece, as the replaced ones fit
    wherever it was. ``there`` has bit x set where there are pieces of length x.
    """
    waste = room - sum(chosen)
    # Bit s: some one piece, or two and more, add up to s.
    one, more = 0, 0
    for x in chosen:
        more |= (one | more) << x
        one |= 1 << x
        if counts[x] <= chosen.count(x):
            there &= ~(1 << x)
    # Sums that a piece exceeds by 1 to ``waste``.
    sums, reach = one | more, 0
    step, width = sums << 1, 1
    while waste:
        if waste & 1:
            reach = reach << width | step
        step |= step << width
        width *= 2
        waste >>= 1
    return bool((more | reach) & there)


def fillings(counts: np.ndarray, room: int) -> tuple[list[list[int]], bool, int]:
    """``(fillings, whether all, steps)``: undominated fillings of ``room``, least waste first, then those with the longest pieces.

    Pieces are tried from long to short. A branch ends when nothing is left that fits. Steps are bounded,
    and at most ``WIDTH`` fillings are kept.
    """
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    found: list[list[int]] = []
    steps = 0
    # Few lengths are searched through.
    most = FILLING_STEPS if len(lengths) > 16 else 20 * FILLING_STEPS
    stack = [(room, len(lengths) - 1, [])]
    while stack and steps < most:
        left, at, chosen = stack.pop()
        steps += 1
        at = min(at, bisect_right(lengths, left) - 1)
        if at < 0:
            found.append(chosen)
            continue
        x = lengths[at]
        stack.append((left, at - 1, chosen))
        if chosen.count(x) < counts[x]:
            stack.append((left - x, at, [*chosen, x]))
    found = found or [[]]
    found.sort(key=lambda f: (room - sum(f), [-x for x in f]))
    there = sum(1 << x for x in lengths)
    kept = []
    for chosen in found:
        if not kept or not dominated(chosen, counts, there, room):
            if len(kept) == WIDTH:
                return kept, False, steps
            kept.append(chosen)
    return kept, not stack, steps


def completions(counts: np.ndarray, capacity: int, limit: int, most: int, steps: int) -> tuple[Plan | None, bool, int]:
    """``(plan, complete, steps left)``: branch and bound around the longest piece, at most ``limit`` choices from the first.

    Every node fills one sequence around the longest piece left, in one of its undominated fillings and
    as often as the counts allow; another filling, or fewer copies, is a choice away. A node is cut when
    its sequences, and those that its remaining tokens need at the least, reach ``most``. ``complete``
    tells that no node was cut for its choices, so that nothing better exists.
    """
    sizes = np.arange(len(counts))
    best, complete = None, True
    stack = [(counts, 0, limit, None)]
    while stack and steps > 0:
        counts, used, limit, plan = stack.pop()
        present = np.flatnonzero(counts)
        if used + -(-int(counts @ sizes) // capacity) >= most:
            continue
        if not present.size:
            best, most = plan, used
            continue
        longest = int(present[-1])
        counts[longest] -= 1
        ways, whole, taken = fillings(counts, capacity - longest)
        counts[longest] += 1
        complete, steps = complete and whole, steps - taken - NODE_STEPS
        nexts = []
        for i, chosen in enumerate(ways):
            need = np.bincount([longest, *chosen], minlength=len(counts))
            held = np.flatnonzero(need)
            copies = int((counts[held] // need[held]).min())
            for fewer in range(copies):
                if i + fewer > limit:
                    complete = False
                    break
                rest = counts.copy()
                rest[held] -= (copies - fewer) * need[held]
                nexts.append((rest, used + copies - fewer, limit - i - fewer, (copies - fewer, (longest, *chosen), plan)))
        stack.extend(reversed(nexts))
    found = None
    if best is not None or most == 0:
        found = []
        while best:
            found.append(best[:2])
            best = best[2]
    return found, complete and not stack, steps


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing on counts: equal bins are handled together."""
    bins: dict[tuple[int, ...], int] = {}
    rooms: dict[int, list[tuple[int, ...]]] = {}
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            fits = [r for r in rooms if r >= x]
            room = min(fits, default=capacity)
            old = rooms[room][-1] if fits else ()
            each = 1 if fits else min(room // x, left)
            number = min(bins[old], left) if fits else left // each
            new = old + (x,) * each
            if fits:
                bins[old] -= number
                if not bins[old]:
                    del bins[old]
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
            if new not in bins:
                rooms.setdefault(room - x * each, []).append(new)
            bins[new] = bins.get(new, 0) + number
            left -= number * each
    return [(n, b) for b, n in bins.items()]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that are needed at the least: for all tokens, and for the pieces of which no two share one."""
    sizes = np.arange(len(counts))
    return max(-(-int(counts @ sizes) // capacity), int(counts[capacity // 2 + 1 :].sum()))


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """``(patterns, bound)`` for ``counts[length]`` pieces: the plan, and the fewest sequences that any plan can have.

    Best fit decreasing is the first incumbent. Where it needs more than the bound, bins are completed by
    branch and bound, first along the first choices, then with more and more others, until the bound
    is met, everything has been searched (then ``bound`` is the optimum), or ``STEPS`` steps have been
    made. The number of sequences and ``bound`` tell how far from the optimum a plan can be.
    """
    plan = best_fit(counts, capacity)
    bound, most = lower_bound(counts, capacity), sum(n for n, _ in plan)
    limit, steps, width = 0, STEPS, int(counts.sum())
    while most > bound and steps > 0 and limit <= width:
        better, complete, steps = completions(counts, capacity, limit, most, steps)
        if better is not None:
            plan, most = better, sum(n for n, _ in better)
        if complete:
            bound = most
        limit = 2 * limit + 1 if limit > 8 else limit + 1
    patterns, first = [], 0
    for copies, lengths in plan:
        items: dict[int, int] = {}
        for x in lengths:
            items[x] = items.get(x, 0) + 1
        patterns.append(Pattern(first, copies, tuple(items.items())))
        first += copies
    return patterns, bound


def plain_tokenizer(definition: str) -> tuple[Tokenizer | None, np.ndarray]:
    """A tokenizer for words of lower-case letters in composed form, and which ids end a word.

    On such words the normalisation and the pattern that takes texts apart change nothing, so they are
    left out: most of the time is theirs. None if the definition is not of this kind.
    """
    parts = json.loads(definition)
    normal = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
    before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    pattern = before[0].get("pattern", {}).get("Regex", "")
    suffix = parts["model"].get("end_of_word_suffix")
    if normal != ["NFC", "Replace", "Lowercase"] or "[\\p{L}]+" not in pattern or before[0].get("behavior") != "Removed" or not suffix:
        return None, np.zeros(0, bool)
    vocab = parts["model"]["vocab"]
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
    parts["normalizer"] = None
    parts["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    return Tokenizer.from_str(json.dumps(parts)), ends


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; words are encoded once and kept while there is room."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.plain, self.ends = plain_tokenizer(definition)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.bytes = 0

    def words(self, text: str) -> list[str] | None:
        """Parts of a text that can be encoded one by one, None if it has to be encoded whole.

        The tokenizer lower-cases by itself; doing that to A-Z before leaves fewer words to encode.
        """
        if any(c in text for c in ODD):
            return None
        return ENDING.sub(r" \g<0>", text.encode().lower().decode()).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if self.bytes > CACHED:
            # Most words are met once; those met again stay, unless they are too many themselves.
            kept = {w: self.known[w] for w in self.again}
            size = self._size(kept)
            self.known, self.bytes = (kept, size) if size < CACHED // 2 else ({}, 0)
            self.again.clear()
        met = set().union(*(words for words in split if words))
        new = met.difference(self.known)
        self.again.update(met.difference(new))
        new = list(new)
        added = dict(zip(new, self._words(new), strict=True))
        self.known.update(added)
        self.bytes += self._size(added)
        find = self.known.__getitem__
        return [self._ids(t) if words is None else b"".join(map(find, words)) for t, words in zip(texts, split, strict=True)]

    @staticmethod
    def _size(words: dict[str, bytes]) -> int:
        return sum(map(len, words)) + sum(map(len, words.values()))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word. Many are encoded in one call, with a word of its own between them."""
        if self.plain:
            simple = [w.isalpha() and w == w.lower() and is_normalized("NFC", w) for w in words]
            found = self._plain([w for w, s in zip(words, simple) if s])
            others = self._marked([w for w, s in zip(words, simple) if not s])
            yield from (next(found) if s else next(others) for s in simple)
        else:
            yield from self._marked(words)

    def _plain(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of lower-case letters: each ends with the first id that ends a word."""
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                yield from (data[a:b] for a, b in zip([0, *stops], stops))
            else:
                yield from map(self._ids, part)

    def _marked(self, words: list[str]) -> Iterator[bytes]:
        mark = self._ids(BREAK)
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            plain = [w for w in part if BREAK not in w]
            ids = np.frombuffer(self._ids(f" {BREAK} ".join(plain)), "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else []
            if len(plain) and len(cuts) == len(plain) - 1:
                starts, data = [0, *(4 * (cuts + 1)).tolist()], ids.tobytes()
                found = iter([data[a:b] for a, b in zip(starts, [*(4 * cuts).tolist(), len(data)], strict=True)])
            else:
                found = map(self._ids, plain)
            for w in part:
                yield self._ids(w) if BREAK in w else next(found)


_encoders: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The encoder of this Python process: the next task finds the words it already knows."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def pieces(docs: DataFrame, definition: str, key: str, text: str, capacity: int, ids: bool = False) -> DataFrame:
    """``doc, piece, start, length, ids_crc32`` of every document's tokens and its closing id, in pieces of at most ``capacity``.

    ``ids`` adds the tokens themselves. The tokenizer drops white space and never joins across it,
    so a text is encoded word by word.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    columns = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    columns += [("ids", pa.list_(pa.int32()))] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition)
        for batch in batches:
            take, out = [], []
            for i, data in enumerate(_encoded(encoder, batch.column("text"))):
                data += END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    take.append(i)
                    row = (k, k * capacity, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if ids else row)
            values = list(zip(*out, strict=True)) or [[] for _ in columns]
            arrays = [pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(take, pa.int64())), *arrays], ["doc", *[n for n, _ in columns]]
            )

    schema = f"doc {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return rows.mapInArrow(run, schema)


def _encoded(encoder: Encoder, texts: pa.Array) -> Iterator[bytes]:
    part, size = [], 0
    for text in (t for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()):
        part.append(text or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield from encoder.encode(part)
            part, size = [], 0
    yield from encoder.encode(part)


def ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 among rows of equal ``length``."""
    buckets = max(BUCKETS, n_rows // BUCKET_ROWS)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32"))
    return (
        placed.withColumn("nth", nth)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("nth") - 1)
        .drop("bucket", "base", "nth")
    )


def slots(patterns: list[Pattern]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """For each length, its ``(from, to, first sequence, pieces in each, offset)`` by rank."""
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for p in patterns:
        offset = 0
        for length, often in p.items:
            own = by_length.setdefault(length, [])
            begin = own[-1][1] if own else 0
            own.append((begin, begin + p.copies * often, p.first, often, offset))
            offset += length * often
    return list(by_length.items())


def pack(
    docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Every document, also one with NULL or empty text, ends with id 0. Only documents longer than
    ``capacity`` are cut. NULL keys and repeated rows are packed like any other; other columns are
    ignored; an empty table gives an empty result. ``definition`` is the content of the tokenizer
    file, read on the driver, so tasks need no file.
    """
    spark = docs.sparkSession
    rows = staged(pieces(docs, definition, key, text, capacity, ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    found = slots(solve(counts, capacity)[0])
    # One row per length: at most ``capacity`` rows, whatever the number of documents.
    plan = spark.createDataFrame(
        found, "length long, slots array<struct<begin:bigint,stop:bigint,first:bigint,often:bigint,offset:bigint>>"
    )
    placed = ranked(rows, int(counts.sum())).join(F.broadcast(plan), "length")
    slot = F.filter("slots", lambda s: (s["begin"] <= F.col("rank")) & (F.col("rank") < s["stop"]))[0]
    placed = placed.withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.begin"))
    return placed.select(
        F.col("doc").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("slot.first") + F.floor(F.col("k") / F.col("slot.often"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + F.col("k") % F.col("slot.often") * F.col("length")).alias("offset"),
        *["ids"] * ids,
    )


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()

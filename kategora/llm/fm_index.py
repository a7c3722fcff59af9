"""Bidirectional FM-index over a set of words, and a search scheme for words one error away.

The words stand one after the other in a circular text, each behind a delimiter. The index of the
text extends a pattern to the left, that of the reversed text to the right; a pattern is an interval
of suffix ranks in both, kept in step. The interval of delimiter, word, delimiter holds one rank,
which tells the word.

All patterns of a search are extended together, one character at a time: the work of a step is a few
array operations, whatever the number of words.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0
# Ranks between two checkpoints of the character counts: the bits of a number.
STEP = 64


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a circular text, sorted; by ever longer prefixes, no two rotations may be equal."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length, at = 1, np.arange(n)
    while True:
        # As many prefixes as one number can hold.
        key, size = rank, int(rank.max()) + 1
        width = max(2, 62 // max(1, size.bit_length()))
        for i in range(1, width):
            key = key * size + rank[(at + i * length) % n]
        order = np.argsort(key)
        rise = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = rise
        if rise[-1] == n - 1:
            return order
        length *= width


class Counts:
    """Burrows-Wheeler transform of a text, with counts of characters up to any rank."""

    def __init__(self, text: np.ndarray, order: np.ndarray, size: int):
        n = len(text)
        blocks, self.width = n // STEP + 1, size + 1
        self.last = text[order - 1]
        # bits[b, c] marks the characters below c in block b, less[b, c] counts them in the blocks before.
        block, bit = np.divmod(np.arange(n), STEP)
        bits = np.zeros(blocks * self.width, np.uint64)
        np.add.at(bits, block * self.width + self.last + 1, np.uint64(1) << bit.astype(np.uint64))
        bits = bits.reshape(blocks, self.width).cumsum(1, dtype=np.uint64)
        less = np.zeros((blocks, self.width), np.int64)
        np.cumsum(np.bitwise_count(bits)[:-1], axis=0, dtype=np.int64, out=less[1:])
        self.bits, self.less = bits.ravel(), less.ravel()
        self.first = np.r_[0, np.bincount(text, minlength=size).cumsum()]

    def upto(self, rank: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many characters before ``rank`` are below ``char``, and how many equal it."""
        at = (rank // STEP) * self.width + char
        inside = (np.uint64(1) << (rank % STEP).astype(np.uint64)) - np.uint64(1)
        below = self.less[at] + np.bitwise_count(self.bits[at] & inside)
        return below, self.less[at + 1] + np.bitwise_count(self.bits[at + 1] & inside) - below


class Intervals:
    """Patterns as intervals: ``left`` and ``right`` are first ranks in the text and in the reversed text."""

    def __init__(self, left: np.ndarray, right: np.ndarray, size: np.ndarray):
        self.left, self.right, self.size = left, right, size

    def __getitem__(self, chosen) -> Intervals:
        return Intervals(self.left[chosen], self.right[chosen], self.size[chosen])

    @staticmethod
    def joined(parts: list[Intervals]) -> Intervals:
        return Intervals(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("left", "right", "size")))


class BiIndex:
    """Index of distinct words, given as their characters (numbers from 1) one after the other, and their lengths."""

    def __init__(self, chars: np.ndarray, lengths: np.ndarray, size: int):
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]].astype(np.int64)
        text = np.full(int(lengths.sum() + len(lengths)), DELIMITER, np.int64)
        held = np.ones(len(text), bool)
        held[starts] = False
        text[held] = chars
        order = rotations(text)
        self.words = np.searchsorted(starts, order[: len(lengths)])
        back = text[::-1]
        self.sides = {True: Counts(text, order, size), False: Counts(back, rotations(back), size)}
        self.n = len(text)

    def everything(self, number: int) -> Intervals:
        return Intervals(np.zeros(number, np.int64), np.zeros(number, np.int64), np.full(number, self.n, np.int64))

    def extended(self, at: Intervals, char: np.ndarray, to_left: bool) -> Intervals:
        """Every pattern with one more character; size 0 where that is in no word."""
        side = self.sides[to_left]
        own, other = (at.left, at.right) if to_left else (at.right, at.left)
        below, equal = side.upto(own, char)
        below_end, equal_end = side.upto(own + at.size, char)
        own, other = side.first[char] + equal, other + below_end - below
        size = equal_end - equal
        return Intervals(own, other, size) if to_left else Intervals(other, own, size)

    def followers(self, at: Intervals, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, character)`` of all characters, not delimiters, that stand next to each pattern."""
        side = self.sides[to_left]
        own = at.left if to_left else at.right
        kinds = len(side.first) - 1
        few = np.flatnonzero(at.size <= kinds)
        many = np.flatnonzero(at.size > kinds)
        # A small interval is read; of a large one every character is tried.
        pattern = np.repeat(few, at.size[few])
        rank = np.arange(len(pattern)) - np.repeat(np.cumsum(at.size[few]) - at.size[few], at.size[few]) + own[pattern]
        pairs = np.unique(np.r_[pattern * kinds + side.last[rank], (many[:, None] * kinds + np.arange(kinds)).ravel()])
        pattern, char = np.divmod(pairs, kinds)
        return pattern[char != DELIMITER], char[char != DELIMITER]


def one_error(index: BiIndex, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)``: words that share one half of a query exactly and have one error in the other.

    Queries are ``chars[start : start + length]``. To the right, the first ``length // 2`` characters
    match and the pattern grows over the others; to the left, the others match and it grows over the first.
    """
    half = lengths // 2
    # Characters of a query in the order of the search, from the delimiter on its exact side.
    origin, step = (starts + lengths - 1, -1) if to_left else (starts, 1)
    whole = lengths - half if to_left else half

    def char(query: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The character at a place, the delimiter behind the last."""
        inside = place < lengths[query]
        return np.where(inside, chars[np.where(inside, origin[query] + step * place, 0)], DELIMITER)

    def grown(query, place, at, with_chars):
        at = index.extended(at, with_chars, to_left)
        left = at.size > 0
        return query[left], place[left], at[left]

    query, place = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    at = index.extended(index.everything(len(lengths)), np.full(len(lengths), DELIMITER), to_left)
    wrong: tuple = (query[:0], place[:0], at[:0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query) or len(wrong[0]):
        # Patterns with their error behind them: only the query's own characters follow.
        q, p, i = wrong
        done = p > lengths[q]
        found.append((q[done], index.words[i.left[done]]))
        q, p, i = q[~done], p[~done], i[~done]
        following = char(q, p)
        nexts = [grown(q, p + 1, i, following)]
        free = (place >= whole[query]) & (place <= lengths[query])
        if free.any():
            q, p, i = query[free], place[free], at[free]
            pattern, new = index.followers(i, to_left)
            q2, p2, i2 = q[pattern], p[pattern], i[pattern]
            nexts.append(grown(q2, p2, i2, new))  # one character more than the query
            other = (p2 < lengths[q2]) & (new != char(q2, p2))
            nexts.append(grown(q2[other], p2[other] + 1, i2[other], new[other]))  # another character
            less = p < lengths[q]
            nexts.append(grown(q[less], p[less] + 2, i[less], char(q[less], p[less] + 1)))  # one less, then the next
        wrong = (np.concatenate([n[0] for n in nexts]), np.concatenate([n[1] for n in nexts]), Intervals.joined([n[2] for n in nexts]))
        going = place < lengths[query]
        query, place, at = grown(query[going], place[going] + 1, at[going], char(query[going], place[going]))
    pairs = np.concatenate([q * len(index.words) + w for q, w in found]) if found else np.zeros(0, np.int64)
    return np.divmod(np.unique(pairs), len(index.words))

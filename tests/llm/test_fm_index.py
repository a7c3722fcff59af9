"""Ranks and order of the FM-index, and the work they take."""

import tracemalloc

import numpy as np
import pytest

from kategora.llm import fm_index


def circle(random, words, letters):
    """Distinct words one after the other, each behind a delimiter."""
    made = {tuple(random.integers(1, letters + 1, random.integers(1, 20)).tolist()) for _ in range(words)}
    return np.array([c for w in sorted(made) for c in (fm_index.DELIMITER, *w)], np.int64)


def test_few_sorts(monkeypatch):
    """Every sort compares the longest prefixes that fit a number, so words of usual length take few sorts."""
    text = circle(np.random.default_rng(1), 3_000, 26)
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    order = fm_index.rotations(text)
    monkeypatch.undo()
    twice = np.r_[text, text].astype(">i4").tobytes()
    turns = [twice[4 * i : 4 * (i + len(text))] for i in order]
    assert all(a < b for a, b in zip(turns, turns[1:], strict=False)) and len(sorts) <= 2


@pytest.mark.parametrize("text", [[0], [0, 1], [0, 1, 0, 1, 1], [0, *[1] * 200, 0, *[1] * 199]])
def test_small_texts(text):
    text = np.array(text, np.int64)
    turns = [(text[i:].tolist() + text[:i].tolist()) for i in fm_index.rotations(text)]
    assert turns == sorted(turns)


@pytest.mark.parametrize("words", [1, 9, 200])
def test_counts(words):
    """Against counting, at every rank and for every character, whole blocks and bounds included."""
    text = circle(np.random.default_rng(words), words, 5)
    text = text[: len(text) // fm_index.STEP * fm_index.STEP or len(text)]
    order = np.arange(len(text))
    counts = fm_index.Counts(text, order, 6)
    last = text[order - 1]
    rank, char = (x.ravel() for x in np.meshgrid(np.arange(len(text) + 1), np.arange(6)))
    below, equal = counts.upto(rank, char)
    assert below.tolist() == [(last[:r] < c).sum() for r, c in zip(rank, char, strict=True)]
    assert equal.tolist() == [(last[:r] == c).sum() for r, c in zip(rank, char, strict=True)]


def test_rank_reads_one_number():
    """A rank query does not look at the characters of its block one by one."""
    random = np.random.default_rng(2)
    text = circle(random, 3_000, 26)
    counts = fm_index.Counts(text, fm_index.rotations(text), 27)
    rank, char = random.integers(0, len(text), 100_000), random.integers(0, 27, 100_000)
    tracemalloc.start()
    counts.upto(rank, char)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000 * 128

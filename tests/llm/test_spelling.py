import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kategora.llm import fm_index, spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    out = []
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


@settings(deadline=None, max_examples=80)
@given(st.sets(st.text("abé", min_size=2, max_size=7), min_size=1, max_size=60), st.booleans())
def test_search_scheme(words, to_left):
    """Against all pairs: one half equal, one error in the other; few letters make many near words."""
    words = sorted(words)
    points, lengths = spelling.codes(words)
    letters, chars = np.unique(points, return_inverse=True)
    index = fm_index.BiIndex(chars + 1, lengths, len(letters) + 1)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    query, word = fm_index.one_error(index, chars + 1, starts, lengths, to_left)
    want = set()
    for i, a in enumerate(words):
        half = len(a) // 2
        for j, b in enumerate(words):
            rest = (a[:half], b[: len(b) - len(a) + half], b.endswith(a[half:])) if to_left else (a[half:], b[half:], b.startswith(a[:half]))
            if rest[2] and one_apart(rest[0], rest[1]):
                want.add((i, j))
    assert set(zip(query.tolist(), word.tolist())) == want


def test_intervals_stay_in_step():
    """A pattern grown both ways is found as often as it occurs in the circular text, in both indexes."""
    words = ["banana", "bandana", "ananas"]
    points, lengths = spelling.codes(words)
    letters, chars = np.unique(points, return_inverse=True)
    index = fm_index.BiIndex(chars + 1, lengths, len(letters) + 1)
    code = {chr(c): i + 1 for i, c in enumerate(letters)} | {"$": 0}
    circle = "$" + "$".join(words)
    at, pattern = index.everything(1), ""
    for char, to_left in [("n", True), ("a", False), ("a", True), ("n", False), ("a", False), ("$", False)]:
        at = index.extended(at, np.array([code[char]]), to_left)
        pattern = char + pattern if to_left else pattern + char
        assert at.size[0] == sum((circle * 2)[i:].startswith(pattern) for i in range(len(circle)))
        turns = sorted(circle[i:] + circle[:i] for i in range(len(circle)))
        back = sorted((circle[::-1] * 2)[i : i + len(circle)] for i in range(len(circle)))
        if at.size[0]:
            assert turns[at.left[0]].startswith(pattern) and back[at.right[0]].startswith(pattern[::-1])


def made(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_variants(spark, monkeypatch):
    """Random words of few letters; chains of forms; halves that are dealt to several shards."""
    random = np.random.default_rng(3)
    words = {"".join(random.choice(list("ab"), size=random.integers(7, 10))) for _ in range(600)}
    counts = {w: int(10 ** random.uniform(0.5, 6)) for w in words} | {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "xbcdefghij": 2000}
    want = plain_variants(counts)
    assert sorted(map(tuple, spelling.variants(made(spark, counts)).collect()), key=repr) == want
    monkeypatch.setattr(spelling, "SHARD", 5)
    monkeypatch.setattr(spelling, "SHARD_CHARS", 2_000)
    assert sorted(map(tuple, spelling.variants(made(spark, counts)).collect()), key=repr) == want


def test_texts(spark, docs_of, edges):
    """Misspelt runs, letters beyond A-Z, NULLs, repeated rows and a very long word."""
    rows = [(i, "Straßenbahn ÉCOLES écoles information INFORMATION_information wonderful×wonderful") for i in range(200)]
    docs = edges.unionByName(docs_of(*rows, (500, "longword" * 400), (501, "longword" * 400 + " " + "longword" * 399 + "longwor"), (502, "longword" * 399 + "longwor")))
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(counts) > 12 and max(map(len, counts)) > 3_000
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=repr) == plain_variants(counts)


def test_empty(docs_of):
    assert spelling.spelling_variants(docs_of()).count() == 0
    assert spelling.spelling_variants(docs_of((1, None), (2, "short words"))).count() == 0

import random
from collections import Counter, defaultdict

import pytest

from kategora.llm import jaccard_join as jj
from kategora.llm.components import components


def shingles(text):
    words = (text or "").split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """``doc: (class, links)`` from every pair."""
    sets = {d: shingles(t) for d, t in rows}
    words = {d: tuple((t or "").split()) for d, t in rows}
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (words[a] == words[b] or both and both >= 0.8 * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (find(d), links[d]) for d in sets}


def corpus():
    rng, rows = random.Random(4), []
    base = [[f"w{k}x{i}" for i in range(120)] for k in range(4)]
    for k in range(90):
        words = list(base[k % 4])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"e{rng.randrange(3)}"
        rows.append((k, " ".join(words)))
    rows += [(200, "a b c"), (201, " a\nb  c"), (202, "a b c d e f g"), (203, None), (204, ""), (205, "x" * 9000)]
    return rows + [(300 + k, " ".join(f"own{k}y{i}" for i in range(30))) for k in range(20)]


@pytest.mark.parametrize("block", [256, 7])
def test_brute_force(docs_of, block):
    """Small blocks deal a group of near copies to many tasks; no link is lost or counted twice."""
    rows = corpus()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jj.jaccard_join(docs_of(*rows), block=block).collect()}
    assert got == brute(rows)


def test_edges(edges, docs_of):
    found = jj.jaccard_join(edges)
    assert found.count() == edges.count()
    by = defaultdict(set)
    for r in found.collect():
        by[r["doc_id"]].add((r["text_id"], r["class_id"], r["n_links"]))
    assert by[1] == by[2] == by[3] == {(1, 1, 3)} and by[4] == by[5] == {(4, 4, 3)} and by[None] == {(4, 4, 3), (1, 1, 3)}
    kept = jj.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7, 8, 9]
    assert jj.jaccard_join(docs_of()).count() == 0 and jj.keep_one(docs_of()).count() == 0


def test_depth():
    d = jj.depth()
    assert 1 - (1 - 0.8**d) ** jj.TREES >= jj.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jj.TREES


def test_components(spark):
    """A long chain, a hub and a pair."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5001, 5000), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

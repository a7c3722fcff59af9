import random
import re
import time
from collections import Counter

import pytest

from kategora.llm.line_dedup import drop_lines

PROSE = "the quick brown fox jumps over the lazy dog near riverbank number"


def rest(docs):
    return {(r["doc_id"], r["text"]) for r in drop_lines(docs).collect()}


def test_edges(edges):
    found = drop_lines(edges, count="n_dropped")
    assert found.columns == [*edges.columns, "n_dropped"]
    assert sorted(map(repr, found.drop("n_dropped").collect())) == sorted(map(repr, edges.collect()))


def test_exact_lines_stay_once(docs_of):
    docs = docs_of((3, "My own words.\nAll rights reserved."), (1, "All rights reserved.\nAll rights reserved."), (2, "All  rights\treserved."), (4, "Of it."), (5, "Of it."))
    assert rest(docs) == {(1, "All rights reserved.\nAll rights reserved."), (2, ""), (3, "My own words."), (4, "Of it."), (5, "Of it.")}


def test_digits_are_variable(docs_of):
    docs = docs_of((1, "Page 3 of the manual"), (2, "Page 17 of the manual"), (3, "1 2 3 of"), (4, "4 5 6 of"))
    assert rest(docs) == {(1, "Page 3 of the manual"), (2, ""), (3, "1 2 3 of"), (4, "4 5 6 of")}


def test_variable_fields(docs_of):
    """One word differs from line to line; unlike lines of the same leaf stay."""
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ivy", "jon", "kay", "leo"]
    same = [(i, f"Posted today by {n} under the general news heading") for i, n in enumerate(names)]
    other = (99, "Posted today by whoever cares about quite different things")
    got = rest(docs_of(*same, other))
    assert got == {same[0], other, *[(i, "") for i, _ in same[1:]]}


def test_repeated_rows_and_null_keys(docs_of):
    docs = docs_of((None, PROSE), (None, PROSE), (1, PROSE), (1, PROSE), (1, PROSE + "\nmore"))
    got = [(r["doc_id"], r["text"]) for r in drop_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted([(None, PROSE)] * 2 + [(1, "")] * 2 + [(1, "more")], key=repr)


def test_empty_and_native(docs_of):
    assert drop_lines(docs_of()).count() == 0
    plan = drop_lines(docs_of((1, "a b c"), (2, "a b c")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_rest(docs):
    """The template tree on plain lists: ``(doc_id, text)`` of unique, non-null ids."""
    lines, seen = [], {}
    for doc, text in docs:
        for pos, raw in enumerate((text or "").split("\n")):
            literal = re.sub("[\x20\x09-\x0d]+", " ", raw).strip(" ")
            tokens = re.sub("[^ ]*[0-9][^ ]*", "<*>", literal).split(" ")
            plain = len(tokens) >= 3 and 2 * tokens.count("<*>") <= len(tokens)
            if plain or len(literal) >= 12:
                line = (plain, " ".join(tokens) if plain else literal)
                lines.append((doc, pos, line))
                seen.setdefault(line, set()).add(doc)
    first = {line: min(of) for line, of in seen.items()}

    def grow(group):
        if len(group) < 2 or len(set().union(*(seen[line] for line in group))) < 2:
            return
        rows = [line[1].split(" ") for line in group]
        counts = [Counter(column) for column in zip(*rows)]
        top = [max(c.values()) for c in counts]
        hit = [100 * sum(t != "<*>" and 2 * c[t] > len(group) for t, c in zip(row, counts)) >= 70 * len(row) for row in rows]
        if 2 * sum(hit) >= len(group):
            own = [line for line, h in zip(group, hit) if h]
            within = set().union(*(seen[line] for line in own))
            if len(within) > 1:
                first.update(dict.fromkeys(own, min(within)))
            grow([line for line, h in zip(group, hit) if not h])
            return
        free = [2 * n <= len(group) for n in top]
        sizes = [len(c) for c in counts]
        alike = Counter(zip(sizes, free))
        at = -max((1, alike[n, True], -n, -i) if free[i] else (0, -top[i], 0, -i) for i, n in enumerate(sizes) if n > 1)[3]
        parts = {}
        for line, row in zip(group, rows):
            parts.setdefault(row[at], []).append(line)
        for part in parts.values():
            grow(part)

    leaves = {}
    for plain, line in seen:
        tokens = line.split(" ")
        if plain and len(tokens) >= 6:
            leaves.setdefault((len(tokens), *tokens[:3]), []).append((plain, line))
    for leaf in leaves.values():
        grow(leaf)
    drop = {(doc, pos) for doc, pos, line in lines if first[line] != doc}
    return {(doc, "\n".join(raw for pos, raw in enumerate(text.split("\n")) if (doc, pos) not in drop)) for doc, text in docs}


@pytest.mark.parametrize("seed", [1, 2])
def test_plain_model(docs_of, seed):
    """Few words, so that leaves hold many lines, templates and chance neighbours."""
    draw = random.Random(seed)
    vocab = ["a", "the", "of", "on", "x1", "22"]

    def line():
        kind = draw.random()
        if kind < 0.3:
            return f"user {draw.choice('abc')} has logged {draw.choice(vocab)} from host number {draw.randint(0, 9)}"
        if kind < 0.5:
            return "".join(draw.choice("本日語 ") for _ in range(draw.choice([5, 14])))
        return " ".join(["the", "a", "of"] + [draw.choice(vocab) for _ in range(draw.choice([0, 3, 4, 9]))])

    docs = [(i, "\n".join(line() for _ in range(draw.randint(1, 6)))) for i in range(120)]
    assert rest(docs_of(*docs)) == plain_rest(docs)


@pytest.mark.parametrize("templates", [12, 20])
def test_many_templates_in_a_leaf(docs_of, templates):
    """However many templates share a leaf, each stays in one document only."""
    kinds = ["".join(chr(97 + i // 5 ** k % 5) for k in range(3)) for i in range(templates)]
    docs = [(100 * t + i, f"Sent by the {k}a {k}b {k}c {k}d office clerk name{chr(97 + i)} today") for t, k in enumerate(kinds) for i in range(10)]
    got = rest(docs_of(*docs))
    assert got == {(d, text if d % 100 == 0 else "") for d, text in docs}


def test_scattered_edits(docs_of):
    """Near copies with edits in other places each: every place has several tokens, and one that most lines have."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    draw = random.Random(7)
    docs = [(i, " ".join(w + "x" if k > 2 and draw.random() < 0.1 else w for k, w in enumerate(words))) for i in range(150)]
    assert rest(docs_of(*docs)) == {docs[0], *[(i, "") for i, _ in docs[1:]]}


def test_names_that_recur(docs_of):
    """One template whose every variant is in two documents: one line stays in all."""
    docs = [(2 * i + k, f"Posted today by name{chr(97 + i % 26)}{chr(97 + i // 26)} under the general news heading") for i in range(50) for k in range(2)]
    assert rest(docs_of(*docs)) == {docs[0], *[(d, "") for d, _ in docs[1:]]}


def test_unspaced_and_figures(docs_of):
    """Lines of one token, or of figures, recur where they are literally equal."""
    line, prices = "全著作権所有無断転載を固く禁じます", "12.50 13.75 99.00 1.25"
    docs = [(i, f"{line}\n{prices}\n{i} {i} {i} 1 2 3 4 5") for i in range(50)]
    assert rest(docs_of(*docs)) == {docs[0], *[(i, f"{i} {i} {i} 1 2 3 4 5") for i in range(1, 50)]}


def test_long_lines(docs_of):
    """Two lines of 60,000 tokens in one leaf, a tenth of them different."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000)]
    other = [w + "x" if i > 5 and i % 10 == 0 else w for i, w in enumerate(words)]
    began = time.time()
    assert rest(docs_of((1, " ".join(words)), (2, " ".join(other)))) == {(1, " ".join(words)), (2, "")}
    assert time.time() - began < 60

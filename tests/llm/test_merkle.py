import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kategora.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """The root, and each leaf's ``(siblings before, siblings after)`` level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            proofs[i].append((nodes[run:place], nodes[place + 1 : run + 3]))
            at[i] = place // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, proofs, order = {}, {}, {}
    for name in names:
        order[name] = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        subs[name], proofs[name] = tree([plain_leaf(*r) for r in order[name]])
    root, above = tree([subs[n] for n in names])
    out = []
    for name, upper in zip(names, above):
        for row, lower in zip(order[name], proofs[name]):
            doc, text = row[0], row[4]
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = plain_leaf(*row[:4], text)
            for before, after in lower + upper:
                node = h(*before, node, *after)
            proof = h(*[d for before, after in lower + upper for d in before + after])
            out.append((doc, plain_leaf(*row), subs[name], root, proof, node, node == root))
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, `group` string, rank int")


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 4], [9, 10, 27, 28], [730, 1, 243, 244, 0, 5]])
def test_plain_model(spark, sizes):
    """Groups of one page, of several and of several rounds; one group holds most of the rows."""
    rows = [(n * 1000 + i, f"s{n}", "en", i, f"Ünder {i}\nline\n" if i % 2 else "one line") for n, size in enumerate(sizes) for i in range(size)]
    got = merkle.digests(merkle.manifest(made(spark, rows), merkle.tampered()))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_edges(spark):
    """NULLs in every column, empty and long texts, repeated rows, equal keys with different texts, and pages that are equal."""
    rows = [
        (1, None, None, None, None), (1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 3, "a\nb"), (None, "a", "en", 3, "c\nd"),
        (3, "a", "en", 3, "x\n" * 50_000), (4, "é", None, -5, "\n"), (4, "é", None, -5, "other"), *[(5, "rep", "en", 1, "same\n")] * 800,
    ]
    got = merkle.digests(merkle.manifest(made(spark, rows), merkle.tampered()))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_many_groups(spark):
    """More groups than a page holds."""
    rows = [(i, f"source {i}", "en", i, "t\nu") for i in range(500)]
    got = merkle.digests(merkle.manifest(made(spark, rows), merkle.tampered()))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_untouched_rows_verify(spark):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(10)]
    assert merkle.manifest(made(spark, rows)).filter(~F.col("verified")).count() == 0


def test_empty(spark):
    assert merkle.digests(merkle.manifest(made(spark, []), merkle.tampered())).count() == 0

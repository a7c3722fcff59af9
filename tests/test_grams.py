import random
import re
from collections import Counter

import pytest

from kategora.operators import grams

TEXTS = [None, "", "x", "aa", "aa bb", "aa bb aa bb aa bb aa bb aa bb", "é ab  cd\nab Cd ab", "aa aab aa b_1 aa", "ab cd ab cd ab cd"]


def texts():
    draw = random.Random(3)
    many = [" ".join(draw.choice(["aa", "ab", "aab", "zz", "éé"]) for _ in range(draw.randrange(30))) for _ in range(200)]
    return TEXTS + many + many[:20]


def plain(rows, lo, hi):
    docs, uses = Counter(), Counter()
    for text in rows:
        words = re.findall(r"\w{2,}", (text or "").lower())
        found = [" ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]
        uses.update(found)
        docs.update(set(found))
    return {t: (docs[t], uses[t]) for t in uses}


@pytest.mark.parametrize(("lo", "hi"), [(1, 1), (1, 2), (1, 3), (2, 2), (3, 7), (1, 8)])
def test_counts(spark, monkeypatch, lo, hi):
    """All n-grams, also where batches end inside of one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(t,) for t in texts()], "text string").repartition(3)
        found = {r["term"]: (r["docs"], r["uses"]) for r in grams.gram_counts(df, "text", lo, hi).collect()}
        shown = {r["docs"]: (r["terms"], r["uses"]) for r in grams.gram_histogram(df, "text", lo, hi).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(texts(), lo, hi)
    assert found == want
    terms, uses = Counter(d for d, _ in want.values()), Counter()
    for d, u in want.values():
        uses[d] += u
    assert shown == {d: (terms[d], uses[d]) for d in terms}


def test_one_row_a_word(spark):
    """Eight lengths shuffle no more rows than there are words."""
    df = spark.createDataFrame([("aa bb cc dd ee ff gg hh ii jj",), ("kk ll",)], "text string")
    assert grams._sorted_runs(df, "text", 2, 8).count() == 10
    assert grams.gram_counts(df.limit(0), "text", 1, 8).count() == 0

import re

import pytest
from pyspark.sql import functions as F

from kategora.functions import text as T

EDGES = [
    (1, "１２３abc、。½é!"),
    (2, "　 \t前後の空白 　\n"),
    (3, "a\tb\r\nc　d"),
    (4, None),
    (5, ""),
    (6, "in\u00a0side  ９8 7"),
    (7, "\x1c\x85x y\u2028"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "id long, s string")


def apply(edges, function):
    return dict(edges.select("id", function(F.col("s")).alias("out")).collect())


def expected(function):
    return {i: None if s is None else function(s) for i, s in EDGES}


def test_strip_matches_python(edges):
    assert apply(edges, T.strip) == expected(str.strip)


def test_fold_digits(edges):
    table = str.maketrans("０１２３４５６７８９", "0123456789")
    assert apply(edges, T.fold_digits) == expected(lambda s: s.translate(table))


def test_drop_symbols_matches_python(edges):
    assert apply(edges, T.drop_symbols) == expected(lambda s: re.sub(r"[^\w\s]", "", s))


def test_digit_runs(edges):
    assert apply(edges, T.drop_digits) == expected(lambda s: re.sub(r"\d+", "", s))
    assert apply(edges, T.mask_digits) == expected(lambda s: re.sub(r"\d+", "0", s))


def test_drop_controls(edges):
    assert apply(edges, T.drop_controls) == expected(lambda s: re.sub("[\n\t\r　]", "", s))


def test_null_to_text(edges):
    assert apply(edges, T.null_to_text)[4] == "nan"


def test_sanitize_filename(spark):
    urls = ["https://a.b/c?d=1", r"c:\x*y", 'p"<q>|r']
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    names = [r[0] for r in df.select(T.sanitize_filename(F.col("url"))).collect()]
    assert names == ["https___a.b_c_d=1.html", r"c_\x_y.html", "p__q__r.html"]


def test_tokens_match_python(edges):
    want = expected(lambda s: re.findall(r"(?u)\b\w\w+\b", s.lower()))
    assert apply(edges, T.tokens) == want


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (1, 8), (2, 3)])
def test_ngrams(spark, lo, hi):
    texts = ["aa bb cc aa bb", "aa", "", "xx yy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.ngrams(T.tokens(F.col("t")), lo, hi)).collect()]
    for text, grams in zip(texts, got):
        w = text.split()
        want = [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
        assert grams == want


def test_term_counts(spark):
    df = spark.createDataFrame([("bb aa bb cc bb",), ("",), (None,)], "t string")
    rows = [r[0] for r in df.select(T.term_counts(F.col("t"), 1, 2)).collect()]
    assert dict(rows[0]) == {"aa": 1, "bb": 3, "cc": 1, "bb aa": 1, "aa bb": 1, "bb cc": 1, "cc bb": 1}
    assert rows[1] == [] and not rows[2]


def test_stopwords(spark):
    stop = ["こと", "もの", "いう", "とても", "ある"]
    df = spark.createDataFrame([("美しい こと とても 海",)], "t string")
    got = df.select(T.drop_stopwords(F.split("t", " "), stop)).first()[0]
    assert got == ["美しい", "海"]

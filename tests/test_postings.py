from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from kategora.functions.text import tokens
from kategora.operators import bayes, postings
from kategora.operators.features import term_freq
from kategora.operators.postings import doc_terms, token_places, unnested

ROWS = [
    (1, "the cat and the dog and the cat"),
    (1, "the dog"),
    (None, "and the dog bird"),
    (3, None),
    (4, ""),
    (5, "a b c"),
    (6, "Ünïcode 日本 the cat 日本 the cat"),
    (7, "word"),
]


def table(spark, n=3):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(n)


def test_rows_of_term_freq(spark):
    """Every length, repeated and NULL keys, texts without words."""
    docs = table(spark)
    for lo, hi in [(1, 1), (1, 2), (2, 3), (1, 4)]:
        want = Counter(map(tuple, term_freq(docs, ["doc_id"], "text", lo, hi, outer=True).collect()))
        got = unnested(doc_terms(docs, ["doc_id"], "text", lo, hi, outer=True), ["doc_id", "tf"])
        assert Counter(map(tuple, got.select("doc_id", "term", "tf").collect())) == want


def test_one_row_per_chunk_and_term(spark):
    nested = doc_terms(table(spark, 1), ["doc_id"], "text", 1, 2).collect()
    assert len(nested) == len({r.term for r in nested})
    assert sorted(next(r for r in nested if r.term == "the").tf) == [1, 1, 2, 3]


def test_places(spark):
    docs = table(spark)
    want = docs.select("doc_id", F.posexplode_outer(tokens(F.col("text"))).alias("_at", "token"))
    got = unnested(token_places(docs, ["doc_id"], tokens(F.col("text"))), ["doc_id", "_at"])
    assert Counter(map(tuple, got.select("doc_id", "_at", "token").collect())) == Counter(map(tuple, want.collect()))


def test_chunks_are_bounded(monkeypatch):
    """Rows stay whole and in order, chunks hold few words, one long row is a chunk by itself."""
    monkeypatch.setattr(postings, "CHUNK_WORDS", 8)
    sizes = [3, 0, 2, 20, 1, 1, 1, 0, 7, 2]
    lists = [[f"w{i}"] * n if n else None for i, n in enumerate(sizes)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(lists[a:b], pa.list_(pa.string()))], ["i", "_words"]) for a, b in [(0, 4), (4, 5), (5, 10)]]
    chunks = list(postings._chunks(iter(batches)))
    assert [i for c in chunks for i in c["i"].to_pylist()] == list(range(10))
    assert all(c.num_rows == 1 or sum(sizes[i] + 1 for i in c["i"].to_pylist()) <= 8 for c in chunks)


def test_predict_text_looks_up_its_own_terms(spark, monkeypatch):
    """The model is not shuffled to meet the terms of one text."""
    docs = spark.createDataFrame([(i, f"w{i} common {'cat' if i % 2 else 'dog'}", "c" if i % 2 else "d") for i in range(40)], "doc_id long, text string, category string")
    model = bayes.fit(docs)
    seen = []
    whole = bayes.lookup
    monkeypatch.setattr(bayes, "lookup", lambda rows, known, *rest: seen.append(known.count()) or whole(rows, known, *rest))
    assert model.predict_text(spark, "common cat w1 new") == "c"
    assert seen == [3]


def test_fit_without_keys(spark):
    """A document without a key counts for the frequencies, not for the sums of its class."""
    rows = [(1, "one two", "a"), (None, "one three", "b"), (2, "two two", "b")]
    terms = bayes.fit(spark.createDataFrame(rows, "doc_id long, text string, category string")).terms
    assert {r.term: r.df for r in terms.collect()} == {"one": 2, "two": 2}

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kategora.operators import sampling as S
from kategora.operators.labels import decode_labels, encode_labels, label_vocab, label_vocab_from
from kategora.plans.ordering import key_order, positions


def rows_of(n=600, seed=1):
    """A class holds more than half of all rows; keys are far from evenly spaced."""
    rng = random.Random(seed)
    keys = rng.sample(range(10**6), n // 2) + rng.sample(range(10**12, 10**12 + 10**6), n - n // 2)
    names = rng.choices(["hot", "b", "c", "d"], [60, 20, 15, 5], k=n)
    return list(zip(keys, names))


ROWS = rows_of()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "key long, category string").repartition(7)


def digest(key, seed):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest(), key


def grouped():
    groups = {}
    for key, name in ROWS:
        groups.setdefault(name, []).append(key)
    return groups


def keys(df):
    return {r.key for r in df.collect()}


def test_tail_per_group(table):
    want = {k for ks in grouped().values() for k in sorted(ks)[-40:]}
    assert keys(S.tail_per_group(table, "category", 40, "key")) == want


def test_balance(table):
    least = min(len(ks) for ks in grouped().values())
    want = {k for ks in grouped().values() for k in sorted(ks, key=lambda k: digest(k, 5))[:least]}
    assert keys(S.balance(table, "category", "key", 5)) == want


@pytest.mark.parametrize("share", [0.1, 0.2, 0.33])
def test_split(table, share):
    parts = {r.key: r.part for r in S.split(table, "key", share, 42).collect()}
    size = math.ceil(share * len(ROWS))
    want = set(sorted((k for k, _ in ROWS), key=lambda k: digest(k, 42))[:size])
    assert {k for k, p in parts.items() if p == "test"} == want
    assert len(parts) == len(ROWS)


def test_stratified_split_has_the_overall_size(table):
    rows = S.split(table, "key", 0.17, 42, stratify="category").collect()
    test = [r for r in rows if r.part == "test"]
    assert len(rows) == len(ROWS) and len(test) == math.ceil(0.17 * len(ROWS))
    for name, ks in grouped().items():
        held = {r.key for r in test if r.category == name}
        assert abs(len(held) - 0.17 * len(ks)) <= 1
        assert held == set(sorted(ks, key=lambda k: digest(k, 42))[: len(held)])


def test_three_parts(table):
    rows = S.split3(table, "key").collect()
    sizes = {p: sum(r.part == p for r in rows) for p in ("train", "validation", "test")}
    assert sizes == {"train": 480, "validation": 60, "test": 60}


def test_sample_and_remainder(table):
    drawn = S.sample_fraction(table, 0.1, "key")
    rest = S.remainder(table, drawn, "key")
    assert len(keys(drawn)) == 60
    assert keys(drawn) | keys(rest) == {k for k, _ in ROWS}
    assert not keys(drawn) & keys(rest)


def test_split_does_not_depend_on_partitioning(table):
    one = S.split(table.coalesce(1), "key", 0.2).filter("part = 'test'")
    many = S.split(table.repartition(13), "key", 0.2).filter("part = 'test'")
    assert keys(one) == keys(many)


@pytest.mark.parametrize("k", [2, 5])
def test_folds(table, k):
    """Deal the sorted class codes out in turn; each class then fills its folds in key order."""
    ordered = sorted(ROWS)
    seen = list(dict.fromkeys(name for _, name in ordered))
    codes = sorted(seen.index(name) for _, name in ordered)
    quota = {(c, f): sum(1 for x in codes[f::k] if x == c) for c in range(len(seen)) for f in range(k)}
    want = {}
    for c, name in enumerate(seen):
        slots = [f for f in range(k) for _ in range(quota[c, f])]
        for (key, _), fold in zip([r for r in ordered if r[1] == name], slots):
            want[key] = fold
    got = {r.key: r.fold for r in S.assign_folds(table, k, "category", "key").collect()}
    assert got == want


def test_folds_of_a_class_smaller_than_k(spark):
    few = spark.createDataFrame([(i, "a") for i in range(9)] + [(9, "b"), (10, "b")], "key long, category string")
    folds = [r.fold for r in S.assign_folds(few, 5, "category", "key").collect()]
    assert sorted(folds) == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("shuffle", [False, True])
def test_batches(table, shuffle):
    got = {r.key: r.batch for r in S.assign_batches(table, 16, "key", shuffle).collect()}
    order = sorted((k for k, _ in ROWS), key=(lambda k: digest(k, 42)) if shuffle else None)
    assert got == {k: i // 16 for i, k in enumerate(order)}


def test_vocabularies(spark):
    df = spark.createDataFrame(
        [(3, "国内"), (1, "経済"), (2, "IT"), (4, "IT"), (5, None)], "key long, category string"
    )
    pairs = lambda v: [tuple(r) for r in v.orderBy("label").collect()]
    assert pairs(label_vocab(df)) == [(0, "IT"), (1, "国内"), (2, "経済")]
    assert pairs(label_vocab(df, order="first_seen", order_col="key")) == [(0, "経済"), (1, "IT"), (2, "国内")]
    listed = label_vocab_from(spark, ["経済", "IT"])
    assert pairs(listed) == [(0, "IT"), (1, "経済")]
    coded = {r.key: r.label for r in encode_labels(df, listed).collect()}
    assert coded == {1: 1, 2: 0, 3: None, 4: 0, 5: None}
    with pytest.raises(Exception, match="unknown category"):
        encode_labels(df, listed, on_unknown="error").collect()
    back = decode_labels(spark.createDataFrame([(1,), (0,)], "label int"), listed)
    assert sorted(tuple(r) for r in back.collect()) == [(0, "IT"), (1, "経済")]
    other = spark.createDataFrame([(1,), (7,), (None,)], "label int")
    assert sorted((tuple(r) for r in decode_labels(other, listed).collect()), key=repr) == [(1, "経済"), (7, None), (None, None)]
    with pytest.raises(Exception, match="unknown label"):
        decode_labels(other, listed, on_unknown="error").collect()


@pytest.mark.parametrize("kind", ["string", "timestamp", "struct<a:string,b:int>", "date"])
def test_any_order_key(spark, kind):
    """Positions by keys that are no numbers, with ties and NULLs, whatever the number of splitters."""
    values = [None, None, *[f"2024-0{1 + i % 9}-{1 + i % 28:02d}" for i in range(300)], *["2024-05-05"] * 200]
    if kind.startswith("struct"):
        rows = spark.createDataFrame([(None if v is None else (v, i % 3), i) for i, v in enumerate(values)], f"key {kind}, row int")
    else:
        rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "key string, row int").withColumn("key", F.col("key").cast(kind))
    for buckets in (1, 7, 64, 1024):
        placed = positions(rows, key_order("key", buckets), "place").orderBy("place").collect()
        assert [r["place"] for r in placed] == list(range(1, len(values) + 1))
        assert [r["key"] for r in placed] == sorted((r["key"] for r in placed), key=lambda k: (k is not None, k))
    assert S.tail_per_group(rows.withColumn("by", F.lit("x")), "by", 1, "key").select("key").distinct().count() == 1


@pytest.mark.parametrize("shuffle", [False, True])
def test_batches_keep_every_row(spark, shuffle):
    """Repeated and NULL keys: as many rows out as in, and all batches full but the last."""
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 2, None, None, 5, 1, 7])], "key long, row int")
    got = S.assign_batches(rows, 3, "key", shuffle).collect()
    assert sorted(r["row"] for r in got) == list(range(8))
    assert sorted(r["batch"] for r in got) == [0, 0, 0, 1, 1, 1, 2, 2]
    if not shuffle:
        assert {r["row"] for r in got if r["batch"] == 0} >= {3, 4}

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kategora.llm import vector_file

SCHEMA = "vec_id long, embedding array<float>, id int, ints string, row int"


def found(table, k=5):
    return sorted(map(tuple, vector_file.top_k(table, F.col("vec_id") % 50 == 0, k).collect()), key=repr)


def plain(rows, k=5):
    """Every query against every row."""
    good = [(i, key, [math.floor(256.0 * x) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in good:
        if key is not None and key % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), other is None, other) for j, other, v in good if j != i and len(v) == len(q)]
            out += [(key, rank, other, -s) for rank, (s, _, other) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame([(key, v, 1, "x", 2) for key, v in rows], SCHEMA)


def as_float32(rows):
    return [(key, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for key, v in rows]


@pytest.mark.parametrize("scale", [0.2, 1e-3, 3e4])
def test_brute_force(spark, monkeypatch, scale):
    """Small blocks and groups: several cells, and bounds that are far from exact."""
    monkeypatch.setattr(vector_file, "BLOCK", 3)
    monkeypatch.setattr(vector_file, "GROUP", 150)
    random = np.random.default_rng(1)
    rows = as_float32([(i, (random.normal(size=8) * scale).tolist()) for i in range(500)])
    assert found(made(spark, rows)) == plain(rows)


def test_many_copies(spark):
    """A third of all rows hold one vector; ties go to the smaller id and a query is not its own answer."""
    random = np.random.default_rng(2)
    rows = as_float32([(i, [0.5] * 4 if i % 3 == 0 else random.normal(size=4).tolist()) for i in range(301)])
    assert found(made(spark, rows)) == plain(rows)


def test_edges(spark):
    """NULL vectors, components and ids, values that are not finite, other and no components, repeated ids and rows."""
    one, two = [0.1, 0.2], [0.3, -0.4]
    rows = as_float32([
        (0, one), (0, one), (0, two), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]),
        (None, one), (None, two), (7, two), (7, two), (250, [1.0, 2.0, 3.0]), (300, []), (8, []), (350, [0.0, 0.0]), (-50, two),
    ])
    assert found(made(spark, rows)) == plain(rows)
    assert found(made(spark, rows), k=1) == plain(rows, k=1)


def test_empty(spark):
    assert found(made(spark, [])) == []

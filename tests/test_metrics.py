import math

import pytest
from pyspark.sql import functions as F

from kategora.functions import scores
from kategora.operators import inspect, metrics, probability
from kategora.operators.history import best_epoch, early_stop


def test_weighted_metrics(spark):
    pairs = list(zip([0, 0, 0, 1, 2], [0, 0, 1, 1, 1]))
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = metrics.metrics(df).first()
    assert got.accuracy == pytest.approx(0.6)
    assert got.precision == pytest.approx(0.666667, abs=1e-6)
    assert got.recall == pytest.approx(0.6)
    assert got.f1 == pytest.approx(0.58)
    assert {tuple(r) for r in metrics.confusion(df).collect()} == {(0, 0, 2), (0, 1, 1), (1, 1, 1), (2, 1, 1)}


def test_metrics_when_all_is_wrong(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "label int, prediction int")
    assert tuple(metrics.metrics(df).first()) == (0.0, 0.0, 0.0, 0.0)


def test_argmax_and_threshold(spark):
    rows = [(1, [0.1, 0.9, 0.9]), (2, [1.0, math.nan]), (3, [0.49]), (4, [0.5]), (5, [])]
    df = spark.createDataFrame(rows, "id long, z array<double>")
    best = dict(df.select("id", scores.argmax(F.col("z"))).collect())
    assert best == {1: 1, 2: 1, 3: 0, 4: 0, 5: None}
    chosen = dict(df.select("id", scores.decide(F.col("z"))).collect())
    assert chosen == {1: 1, 2: 1, 3: 0, 4: 1, 5: None}


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 1), ([1000.0, 0.0], 1)], "z array<double>, label int")
    got = [r.loss for r in metrics.log_loss(df, "z", "label").collect()]
    mass = sum(map(math.exp, [1.0, 2.0, 0.5]))
    assert got == pytest.approx([math.log(mass) - 2.0, 1000.0])


def test_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "batch int, loss double")
    assert metrics.mean_loss(df).first().mean_loss == 3.5


HISTORY = [("a", e + 1, v) for e, v in enumerate([1.0, 0.8, 0.795, 0.5, 0.6, 0.4])]
HISTORY += [("b", 1, 1.0), ("b", 2, 0.5), ("c", 1, 0.7)]


def plain_stop(losses, patience, delta):
    best, waited = None, 0
    for epoch, loss in enumerate(losses, 1):
        if best is None or best - loss > delta:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch
    return None


@pytest.mark.parametrize("patience", [1, 2, 3])
@pytest.mark.parametrize("delta", [0.0, 0.01, 0.3])
def test_early_stop(spark, patience, delta):
    history = spark.createDataFrame(HISTORY, "run string, epoch int, loss double").repartition(3)
    got = {r.run: r.stop_epoch for r in early_stop(history, patience, delta).collect()}
    for run in "abc":
        losses = [v for r, _, v in HISTORY if r == run]
        assert got[run] == plain_stop(losses, patience, delta)


def test_known_stop_and_best_epochs(spark):
    history = spark.createDataFrame(HISTORY, "run string, epoch int, loss double")
    stops = early_stop(history, 1, 0.01)
    assert {r.run: r.stop_epoch for r in stops.collect()} == {"a": 3, "b": None, "c": None}
    assert {r.run: r.best_epoch for r in best_epoch(history).collect()} == {"a": 6, "b": 2, "c": 1}
    assert {r.run: r.best_epoch for r in best_epoch(history, stops).collect()} == {"a": 3, "b": 2, "c": 1}


def test_probability_grid_and_pivot(spark):
    grid = probability.probability_grid(spark, 3)
    cells = {(r.p_A, r.p_B): r.p_A_or_B for r in grid.collect()}
    assert cells == {(a, b): a + b - a * b for a in (0.0, 0.5, 1.0) for b in (0.0, 0.5, 1.0)}
    assert probability.probability_grid(spark).count() == 10_000
    wide = inspect.pivot(grid, "p_B", "p_A", "p_A_or_B")
    assert wide.columns == ["p_B", "0.0", "0.5", "1.0"]
    assert {tuple(r) for r in wide.collect()} == {(0.0, 0.0, 0.5, 1.0), (0.5, 0.5, 0.75, 1.0), (1.0, 1.0, 1.0, 1.0)}


def test_pivot_refuses_two_values_for_a_cell(spark):
    df = spark.createDataFrame([("x", "y", 1.0), ("x", "y", 2.0)], "i string, c string, v double")
    with pytest.raises(Exception, match="two values"):
        inspect.pivot(df, "i", "c", "v", ["y"]).collect()


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "category string")
    assert [tuple(r) for r in inspect.value_counts(df, "category").collect()] == [("b", 2), ("a", 1)]
    assert (None, 1) in [tuple(r) for r in inspect.value_counts(df, "category", False).collect()]
    assert inspect.min_class_size(df, "category").first()[0] == 1
    assert {tuple(r) for r in inspect.categories(df).collect()} == {("a", 2), ("b", 2)}

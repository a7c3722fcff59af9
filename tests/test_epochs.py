import numpy as np
import pytest
from pyspark.sql import functions as F

from kategora.operators.epochs import SoftmaxModel, load_softmax, train_epochs


def table(spark, n=200, seed=0):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, 3))
    label = (x @ np.array([[2.0, 0, 0], [0, 2, 0], [-1, -1, 1]]).T).argmax(1)
    return x, label, spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, label)], "embedding array<double>, label int")


def plain(x, label, epochs, rate, decay):
    x = np.c_[x, np.ones(len(x))]
    w, losses = np.zeros((3, 4)), []
    for _ in range(epochs):
        z = np.exp(x @ w.T)
        p = z / z.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(x)), label]).mean())
        grad = (p - np.eye(3)[label]).T @ x / len(x)
        w = w - rate * (grad + decay * np.c_[w[:, :3], np.zeros(3)])
    return w, losses


def test_plain_model_and_resuming(spark, tmp_path):
    x, label, df = table(spark)
    whole = train_epochs(df, 3, 3, 5, rate=0.7, decay=0.01)
    w, losses = plain(x, label, 5, 0.7, 0.01)
    assert np.allclose(whole.weights, w) and np.allclose([a for a, _ in whole.losses], losses)
    train_epochs(df, 3, 3, 2, rate=0.7, decay=0.01).save(spark, str(tmp_path / "m"))
    resumed = train_epochs(df, 3, 3, 3, rate=0.7, decay=0.01, start=load_softmax(spark, str(tmp_path / "m")))
    assert np.allclose(resumed.weights, whole.weights) and resumed.epoch == 5
    assert np.allclose([a for a, _ in resumed.losses], losses)
    got = [r["logits"] for r in whole.transform(df.limit(5)).collect()]
    assert np.allclose(got, np.c_[x[:5], np.ones(5)] @ w.T)


def test_validation_stops_early(spark):
    _, _, df = table(spark, 60)
    shuffled = table(spark, 60, 1)[2].withColumn("label", F.lit(0))
    model = train_epochs(df, 3, 3, 20, rate=2.0, validation=shuffled, patience=2)
    past = [v for _, v in model.losses]
    assert model.epoch < 20 and min(past[-2:]) >= min(past[:-2])
    history = model.history(spark).select("run", "epoch", F.col("validation_loss").alias("loss"))
    assert history.orderBy("loss", "epoch").first()["epoch"] == past.index(min(past)) + 1


def test_rows_that_cannot_be_used(spark):
    _, _, df = table(spark, 30)
    odd = spark.createDataFrame([(None, 1), ([1.0], 1), ([1.0, None, 2.0], 1), ([float("nan")] * 3, 0), ([1.0, 2.0, 3.0], None), ([1.0, 2.0, 3.0], 7)], df.schema)
    assert np.allclose(train_epochs(df.unionByName(odd), 3, 3, 2).weights, train_epochs(df, 3, 3, 2).weights)
    assert (train_epochs(df.limit(0), 3, 3, 2).weights == 0).all()
    with pytest.raises(ValueError):
        train_epochs(df, 3, 3, 1, start=SoftmaxModel.empty(2, 3))
    with pytest.raises(ValueError):
        SoftmaxModel.empty(10**6, 1000)

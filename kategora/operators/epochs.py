"""Softmax regression on dense vectors, trained epoch by epoch, with a loss for each and resuming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.plans.storage import pinned

# Numbers of a model: they are held by the driver and sent to every task.
MAX_WEIGHTS = 4_000_000
CHUNK = 4_096


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights[class, feature]`` after ``epoch`` epochs, the last feature is the constant 1; ``losses`` by epoch."""

    weights: np.ndarray
    epoch: int = 0
    losses: tuple[tuple[float, float | None], ...] = field(default=())

    @staticmethod
    def empty(classes: int, features: int) -> SoftmaxModel:
        if classes * (features + 1) > MAX_WEIGHTS:
            raise ValueError(f"{classes} classes of {features + 1} weights; at most {MAX_WEIGHTS} weights can be trained")
        return SoftmaxModel(np.zeros((classes, features + 1)))

    def history(self, spark: SparkSession, run: str = "0") -> DataFrame:
        """``run, epoch, loss, validation_loss``: the losses that early stopping and the choice of an epoch read."""
        rows = [(run, e, loss, val) for e, (loss, val) in enumerate(self.losses, 1)]
        return spark.createDataFrame(rows, "run string, epoch int, loss double, validation_loss double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the state as Parquet: training can go on from it as if it had not stopped."""
        rows = [(int(c), w.tolist()) for c, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "label int, weights array<double>").write.parquet(f"{path}/weights")
        self.history(spark).coalesce(1).write.parquet(f"{path}/history")

    def transform(self, df: DataFrame, features: str = "embedding") -> DataFrame:
        """``df`` with ``logits``: one score for each class, NULL for a NULL vector."""
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in w[:-1]]) for w in self.weights])
        bias = F.array(*[F.lit(float(w[-1])) for w in self.weights])
        dot = lambda w, c: F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.get(bias, c), lambda s, x: s + x)
        return df.withColumn("logits", F.transform(rows, dot))


def load_softmax(spark: SparkSession, path: str) -> SoftmaxModel:
    rows = spark.read.parquet(f"{path}/weights").orderBy("label").collect()
    past = spark.read.parquet(f"{path}/history").orderBy("epoch").collect()
    losses = tuple((r["loss"], r["validation_loss"]) for r in past)
    return SoftmaxModel(np.array([r["weights"] for r in rows]), len(losses), losses)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """``(gradient, loss, rows)``, each a sum over all rows: every task adds up its own, then sums are added by place."""
    classes, features = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, count = np.zeros((classes, features)), 0.0, 0
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                label = part.column("label").to_numpy(zero_copy_only=False)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), features - 1)
                x = np.hstack([x, np.ones((len(part), 1))])
                logits = x @ weights.T
                logits -= logits.max(1, keepdims=True)
                chance = np.exp(logits)
                total = chance.sum(1, keepdims=True)
                loss += float((np.log(total[:, 0]) - logits[np.arange(len(part)), label]).sum())
                chance /= total
                chance[np.arange(len(part)), label] -= 1
                sums += chance.T @ x
                count += len(part)
        values = np.r_[sums.ravel(), loss, count]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values)], ["at", "value"])

    parts = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = pinned(parts, classes * features + 2).collect()
    values = np.zeros(classes * features + 2)
    for r in found:
        values[r["at"]] = r["value"]
    return values[:-2].reshape(classes, features), float(values[-2]), int(values[-1])


def usable(df: DataFrame, classes: int, size: int, features: str, label: str) -> DataFrame:
    """Rows whose vector has the right length and no NULL, and whose label is a class."""
    x = F.transform(features, lambda v: v.cast("double"))
    rows = df.select(x.alias("x"), F.col(label).cast("int").alias("label"))
    whole = (F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.filter(whole & F.col("label").between(0, classes - 1))


def train_epochs(
    df: DataFrame,
    classes: int,
    size: int,
    epochs: int,
    rate: float = 1.0,
    decay: float = 0.0,
    start: SoftmaxModel | None = None,
    validation: DataFrame | None = None,
    patience: int | None = None,
    features: str = "embedding",
    label: str = "label",
) -> SoftmaxModel:
    """The model after ``epochs`` more epochs of gradient descent over all rows.

    An epoch is one pass: each task sends one sum for every weight, whatever its rows. ``decay`` shrinks
    the weights (not the constant's). ``start`` goes on from a saved state; the result is that of training
    without a stop. With ``validation`` its loss is kept too, and training ends when that has not fallen
    for ``patience`` epochs. Rows with a NULL label or vector, one of another length, or a label that is
    no class are left out; without any row the weights stay as they are.
    """
    model = start or SoftmaxModel.empty(classes, size)
    if model.weights.shape != (classes, size + 1):
        raise ValueError(f"the saved model has {model.weights.shape} weights, not {(classes, size + 1)}")
    rows = usable(df, classes, size, features, label)
    held = None if validation is None else usable(validation, classes, size, features, label)
    for _ in range(epochs):
        sums, loss, count = gradient(rows, model.weights)
        shrink = decay * np.c_[model.weights[:, :-1], np.zeros(classes)]
        weights = model.weights - rate * (sums / max(count, 1) + shrink)
        val = None
        if held is not None:
            _, total, n = gradient(held, weights)
            val = total / max(n, 1)
        model = SoftmaxModel(weights, model.epoch + 1, (*model.losses, (loss / max(count, 1), val)))
        past = [v for _, v in model.losses]
        if patience and val is not None and len(past) > patience and min(past[-patience:]) >= min(past[:-patience]):
            break
    return model

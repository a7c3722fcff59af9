"""Classifiers on dense vectors, and scoring with models from outside Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kategora.functions.scores import argmax, cross_entropy


def with_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))


def fit_dense(
    df: DataFrame,
    features: str = "embedding",
    label: str = "label",
    max_iter: int = 50,
    reg: float = 0.0,
    tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Multinomial logistic regression on an array column."""
    trainer = LogisticRegression(
        featuresCol="_vector",
        labelCol=label,
        family="multinomial",
        maxIter=max_iter,
        regParam=reg,
        tol=tol,
    )
    return trainer.fit(with_vector(df, features).select("_vector", label))


def dense_logits(df: DataFrame, model: LogisticRegressionModel, features: str = "embedding") -> DataFrame:
    """Add the model's class scores as ``logits`` and the chosen class as ``prediction``."""
    scored = model.transform(with_vector(df, features))
    logits = vector_to_array(F.col("rawPrediction"))
    return scored.select(*df.columns, logits.alias("logits")).withColumn(
        "prediction", argmax(F.col("logits"))
    )


def dense_search(
    df: DataFrame,
    regs: Sequence[float],
    part: str = "part",
    features: str = "embedding",
    label: str = "label",
    max_iter: int = 50,
) -> DataFrame:
    """Validation loss of each regularisation: ``(trial_id, reg, loss)``."""
    train = df.filter(F.col(part) == "train").select(features, label).persist()
    held = df.filter(F.col(part) == "validation")
    results = []
    for i, reg in enumerate(regs):
        logits = dense_logits(held, fit_dense(train, features, label, max_iter, reg), features)
        loss = F.avg(cross_entropy(F.col("logits"), F.col(label)))
        results.append(
            logits.agg(loss.alias("loss")).select(F.lit(i).alias("trial_id"), F.lit(float(reg)).alias("reg"), "loss")
        )
    train.unpersist()
    return reduce(DataFrame.unionByName, results)


def score_with(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    features: str,
    width: int,
    out: str = "prediction",
    batch_size: int = 1_024,
) -> DataFrame:
    """Add the class chosen by an outside model.

    ``make_predict`` loads the model once per worker and returns a function from a batch of
    vectors to a batch of score vectors; the batches travel as Arrow.
    """
    scores = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(out, argmax(scores(F.col(features))))

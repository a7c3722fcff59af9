"""Stop rules over training histories: one row per run and epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def early_stop(
    history: DataFrame, patience: int = 3, min_delta: float = 0.0, run: str = "run"
) -> DataFrame:
    """Epoch at which each run stops: ``(run, stop_epoch, best_loss)``.

    The loss must fall by more than ``min_delta`` below the best so far; after ``patience``
    epochs in a row without that the run stops. ``stop_epoch`` is NULL if it never does. An epoch
    is one row per run, so a run's history is a short array.
    """
    ordered = F.sort_array(F.collect_list(F.struct("epoch", "loss")))
    epoch_type = history.schema["epoch"].dataType
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("waited"),
        F.lit(None).cast(epoch_type).alias("stop"),
    )

    def step(state, entry):
        better = state.best.isNull() | (state.best - entry.loss > min_delta)
        waited = F.when(better, 0).otherwise(state.waited + 1)
        moved = F.struct(
            F.when(better, entry.loss.cast("double")).otherwise(state.best).alias("best"),
            waited.alias("waited"),
            F.when(waited >= patience, entry.epoch).alias("stop"),
        )
        return F.when(state.stop.isNotNull(), state).otherwise(moved)

    final = history.groupBy(run).agg(F.aggregate(ordered, start, step).alias("_end"))
    return final.select(
        run, F.col("_end.stop").alias("stop_epoch"), F.col("_end.best").alias("best_loss")
    )


def best_epoch(history: DataFrame, stops: DataFrame | None = None, run: str = "run") -> DataFrame:
    """Epoch with the lowest loss (the earliest of equals), up to the stop if ``stops`` is given."""
    seen = history
    if stops is not None:
        upto = stops.select(run, "stop_epoch")
        seen = history.join(upto, run, "left").filter(
            F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
        )
    best = F.min(F.struct("loss", "epoch"))
    return seen.groupBy(run).agg(best.alias("_best")).select(
        run, F.col("_best.epoch").alias("best_epoch"), F.col("_best.loss").alias("best_loss")
    )

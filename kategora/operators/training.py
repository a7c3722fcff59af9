"""From an article table to a judged model, and from a model to a scored article table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kategora.operators.bayes import Settings, TextModel, fit, score_table
from kategora.operators.labels import encode_labels
from kategora.operators.metrics import metrics
from kategora.operators.prepare import assemble_text, exclude_url
from kategora.operators.sampling import split, tail_per_group
from kategora.operators.search import Trial, best_trial, grid_search


@dataclass(frozen=True)
class Trained:
    """A model, the cross-validation results it was chosen by, and its metrics on unseen rows."""

    model: TextModel
    trial: Trial
    results: DataFrame
    metrics: DataFrame


def prepare_articles(
    articles: DataFrame, order_col: str, needle: str | None = "/pickup/", tail: int | None = 2_000
) -> DataFrame:
    """Articles to train on: without overview pages, the last ``tail`` of each category."""
    kept = exclude_url(articles, needle) if needle else articles
    return tail_per_group(kept, "category", tail, order_col) if tail else kept


def train_articles(
    articles: DataFrame,
    trials: Sequence[Trial],
    key: str = "row_key",
    sep: str = " ",
    clean: str = "none",
    test: float = 0.2,
    folds: int = 5,
    seed: int = 42,
) -> Trained:
    """Hold out a stratified part, search on the rest, train on it again, judge on the part."""
    documents = assemble_text(articles, sep, clean).filter(F.col("text").isNotNull())
    parts = split(documents.select(key, "category", "text"), key, test, seed, stratify="category")
    train, held = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    results = grid_search(train, trials, folds, key)
    chosen = best_trial(results).first().trial_id
    trial = next(t for t in trials if t.trial_id == chosen)
    settings = Settings(trial.lo, trial.hi, trial.min_df, trial.alpha)
    model = fit(train, replace(settings, sep=sep, clean=clean), key)
    guessed = model.transform(held, key).select(key, F.col("label").alias("prediction"))
    truth = encode_labels(held.select(key, "category"), model.classes)
    return Trained(model, trial, results, metrics(truth.join(guessed, key)))


def score_articles(
    articles: DataFrame, model: TextModel, key: str = "row_key", out: str = "predicted_category"
) -> DataFrame:
    """All columns plus the text, put together as in training, and the predicted category."""
    s = model.settings
    return score_table(assemble_text(articles, s.sep, s.clean), model, key, out=out)

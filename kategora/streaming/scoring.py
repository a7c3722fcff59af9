"""Append predicted categories to articles as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kategora.operators.bayes import TextModel, score_table


def score_stream(
    articles: DataFrame, model: TextModel, key: str, out_path: str, checkpoint: str, text: str = "text"
) -> StreamingQuery:
    """Score each micro-batch with the trained model and write it as Parquet.

    A batch is written to a folder of its own number, so a batch that is run again after a
    failure replaces its rows and does not add them twice. No state is kept between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = score_table(batch, model, key, text)
        scored.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

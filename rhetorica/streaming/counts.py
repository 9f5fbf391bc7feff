"""N-gram counts over a stream of texts: counts are sums, so training can go on as text arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rhetorica.operators import ngrams


def running_counts(stream: DataFrame, n: int, model: str = "model", tokens: str = "tokens") -> DataFrame:
    """(model, ord, ctx, tok, c) of all text so far, as a streaming aggregation.

    Write it in complete or update mode. A model is built from any snapshot with ``lm.build``.
    """
    return ngrams.conditional_counts(stream, n, model, tokens)


def keep_counts(stream: DataFrame, n: int, path: str, checkpoint: str, model: str = "model", tokens: str = "tokens"):
    """Starts a query that appends the counts of every micro-batch under ``path``, each batch in its own
    folder, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ngrams.conditional_counts(batch, n, model, tokens).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

"""Searching for streams of queries: each micro-batch is one batched search on a finished index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Index


def search_stream(index: Index, queries: DataFrame, pool: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``sink(result, epoch)`` for each micro-batch of the streaming ``queries(qid, vec)``.

    The checkpoint records which input has been handled; a sink that is idempotent by epoch makes it exactly once.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        sink(index.search(batch, pool), epoch)

    return queries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

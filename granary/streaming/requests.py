"""Requests from a stream: each micro-batch goes through a batch function, memoised by request key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Answer a stream of requests into a Parquet folder.

    Requests of a batch that share ``key`` are answered once; ``answer`` gets one row for each key.
    Each batch has its own folder and overwrites it, so a repeated batch leaves no duplicates.
    """

    def run(batch: DataFrame, number: int) -> None:
        answer(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

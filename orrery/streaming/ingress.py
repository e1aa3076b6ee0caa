"""Bounded intake: a queue that says when it is full, and rate limits for file streams."""

from __future__ import annotations

import queue
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Full(Exception):
    """The queue holds as much as it may."""


class Ingress:
    """Hands rows from producers to the batch that comes next; never blocks and never drops."""

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self._rows: queue.Queue[Any] = queue.Queue(capacity)

    def offer(self, row: Any) -> None:
        try:
            self._rows.put_nowait(row)
        except queue.Full:
            raise Full from None

    def take(self) -> Any | None:
        try:
            return self._rows.get_nowait()
        except queue.Empty:
            return None

    def batch(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows that wait, as a DataFrame: capacity bounds what the driver holds."""
        rows = []
        while (row := self.take()) is not None:
            rows.append(row)
        return spark.createDataFrame(rows, schema)

    def __len__(self) -> int:
        return self._rows.qsize()


def limited(spark: SparkSession, path: str, files: int, bytes_per_trigger: str | None = None) -> DataFrame:
    """A stream of Parquet files, so many of them (or bytes) at a time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)

"""What tasks keep between texts: bounded memories, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 4_000_000
VOCABULARY_LIMIT = 64_000_000


class Memo(dict):
    """Results by key, made on first use; emptied when ``limit`` keys are held, so memory is bounded."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file, for a broadcast: a constant of the run, refused above ``VOCABULARY_LIMIT`` bytes."""
    with open(path, "rb") as file:
        content = file.read(VOCABULARY_LIMIT + 1)
    if len(content) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} has more than {VOCABULARY_LIMIT} bytes")
    return content


def small_batches(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes each (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def broadcast_bytes(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


@contextmanager
def small_exchanges(spark: SparkSession, rows: int = 500):
    """Spark hands at most ``rows`` rows at a time to Python in what is run inside; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)

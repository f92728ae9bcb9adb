"""What Python workers hold between and during their tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 512


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A worker outlives its task and keeps what it has freed; so run's memory goes back to the system when it ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return out


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside: at most ``TEXTS`` rows in a batch. A worker gets a batch whole and holds the one before, so batches of ten thousand
    texts are most of its memory as soon as a partition has so many."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), TEXTS) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)

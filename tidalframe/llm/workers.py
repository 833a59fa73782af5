"""Memory of Python workers: Spark keeps a worker for later tasks, and an idle one should hold little."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of text that travel to a worker at once.
TEXT_ROWS = 1000


def _trim() -> None:
    """Give freed memory back to the system; a C library without malloc_trim keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to workers TEXT_ROWS at a time: its default holds whole batches of ten times as many texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no freed memory behind in its worker."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return released

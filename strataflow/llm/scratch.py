"""The shared scratch folder, under the name that this subpackage uses, and what keeps Python workers small.

Spark reuses Python workers for other tasks and stages. ``lean`` makes a task give its memory back at its end, and batches of
texts are bounded by rows and by bytes.
"""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from strataflow.shared import broadcast_if_small, cut, folder, remove, tasks, tidy, write

__all__ = ["bounded_batches", "broadcast_if_small", "cut", "folder", "lean", "remove", "tasks", "tidy", "write"]
BATCH_ROWS, BATCH_BYTES, READ_BYTES = 512, 1 << 20, 1 << 18


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: let an Arrow batch hold BATCH_ROWS rows and BATCH_BYTES at most (or one text), whatever the session allows for numbers.

    The Parquet reader takes its columns in pieces of READ_BYTES and its batches, by rows only, beside the heap, as their arrays of bytes double
    as they grow and are kept. A row group's texts in one array, as vectored reads want it, need free heap in a row, which Spark's pages break up.
    """
    limits = (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "64MB"),
        ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS, "4096"),
        ("parquet.read.allocation.size", READ_BYTES, "8388608"),
    )
    for key, most, default in limits:
        now = spark.conf.get(key, default)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    spark.conf.set("spark.sql.columnVector.offheap.enabled", "true")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker returns what it has freed to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return whole

"""Bounded memory for Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows in an Arrow batch at most, where batches hold whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts stay small on both sides; the session's setting is only ever lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def lean(run):
    """A function over batches or groups that gives its memory back at the end of its task or group."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def batches(*args):
            yield from run(*args)
            give_back()

        return batches

    def call(*args):
        try:
            return run(*args)
        finally:
            give_back()

    # Spark looks at the number of parameters
    return {1: lambda a: call(a), 2: lambda a, b: call(a, b), 3: lambda a, b, c: call(a, b, c)}[len(inspect.signature(run).parameters)]

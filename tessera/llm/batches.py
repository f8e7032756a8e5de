"""How texts go to Python workers."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

from tessera.session import settings

#: Rows of an Arrow batch; texts are some kilobytes each, so a batch is some megabytes.
ROWS = 1000


def small_batches(spark: SparkSession):
    """Bound what a worker holds of texts at once; Spark's default of rows a batch is ten times that.

    The setting counts when a plan is made or run, so whoever returns a lazy DataFrame runs it inside.
    """
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(ROWS))


def tidy() -> None:
    """Give memory that is no longer used back to the system; workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)

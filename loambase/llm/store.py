"""Tables in the folder that driver and executors share, and the size of batches for Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.scratch import materialize, scratch_path, shared_dir

__all__ = ["materialize", "scratch_path", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, size: str = "8MB") -> None:
    """Bound the bytes of a batch that goes to a Python worker, unless the session does: rows are whole
    documents, and 10,000 long ones don't fit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)

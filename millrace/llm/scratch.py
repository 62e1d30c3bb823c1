"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..storage import claimed, discard, release, shared_dir, stored

__all__ = ["claimed", "discard", "release", "shared_dir", "small_batches", "stored"]

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Within it, jobs hand texts to Python in Arrow batches of that size at most: a bound on memory, not on results."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)

"""Batches of long texts for Python."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

MOST_ROWS, MOST_BYTES = 500, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python functions of jobs that run inside get :data:`MOST_ROWS` rows and :data:`MOST_BYTES` at a time, at most, so that what a
    worker holds does not follow the length of texts."""
    before = {}
    for key, most in (("maxRecordsPerBatch", MOST_ROWS), ("maxBytesPerBatch", MOST_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        before[key] = spark.conf.get(key)
        now = int(before[key].rstrip("b"))
        spark.conf.set(key, str(min(now, most) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

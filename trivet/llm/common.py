"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse, unless that
    is local to each machine of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = house + "/trivet-scratch"
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, any executor can reread it,
    and the planner knows its true size."""
    return Scratch(df.sparkSession).cut(df)


class Scratch:
    """Tables that an operator writes to the shared folder, and removes as soon as later ones replace them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/trivet-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def free(self, *tables: DataFrame) -> None:
        """Remove tables of :meth:`cut` that nothing reads any more; other tables are left alone."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for _, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.held = [h for h in self.held if not any(h[0] is t for t in tables)]


@contextmanager
def batches_of_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions of jobs that run inside get ``rows`` rows at a time, at most: for rows that are long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def no_cycles() -> Iterator[None]:
    """No search for reference cycles inside: with millions of small objects and no cycles it is a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its task, and what it still holds would stand beside the
    next one's data."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times and it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is.

    ``lower`` does the same on pure ASCII and has a fast path there; other texts go through ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

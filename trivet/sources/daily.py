"""Tables laid out by day, and their retention."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "__HIVE_DEFAULT_PARTITION__"


def write_daily(rows: DataFrame, time_col: str, path: str, mode: str = "append") -> None:
    """Parquet in one folder a day (``day=2024-01-31``); rows without a time have a folder of their own. Rows go to as few tasks a day as
    their bytes ask for."""
    rows.withColumn("day", F.to_date(time_col)).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def days_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the days' folders, a few a year."""
    at, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n.removeprefix("day=") for n in names if n.startswith("day="))


def expire_daily(spark: SparkSession, path: str, time_col: str, now: dt.datetime, days: int = 30) -> dict[str, list[str]]:
    """Remove what is older than ``days`` before ``now`` (a time of the session's zone): whole days by their folders, and of the day
    that the limit falls into only what is older. Files of later days are not touched, nor are rows without a time.

    The border day is written anew beside the table and put in place by renaming; a run that ends in between leaves the day
    readable or is mended by the next run. Returns the days that were ``removed`` and ``rewritten``."""
    limit = now - dt.timedelta(days=days)
    border = limit.date().isoformat()
    at, fs = _files(spark, path)
    folder = lambda day: spark._jvm.org.apache.hadoop.fs.Path(at, f"day={day}")
    for status in fs.listStatus(at):  # what an earlier run left behind
        name = status.getPath().getName()
        if name.startswith("_new_") or name.startswith("_old_"):
            day = name.split("_")[2]
            if name.startswith("_old_") and not fs.exists(folder(day)):
                fs.rename(status.getPath(), folder(day))
            else:
                fs.delete(status.getPath(), True)
    known = [d for d in days_of(spark, path) if d != UNKNOWN]
    removed = [d for d in known if d < border]
    for day in removed:
        fs.delete(folder(day), True)
    rewritten = []
    if border in known:
        rows = spark.read.parquet(f"{path}/day={border}")
        old = F.col(time_col) < F.lit(limit.isoformat(sep=" ")).cast(rows.schema[time_col].dataType)
        if not rows.filter(old).isEmpty():
            new, back = (spark._jvm.org.apache.hadoop.fs.Path(at, f"_{kind}_{border}_{uuid.uuid4().hex}") for kind in ("new", "old"))
            rows.filter(~old).write.parquet(new.toString())
            empty = spark.read.schema(rows.schema).parquet(new.toString()).isEmpty()
            fs.rename(folder(border), back)
            if not empty:
                fs.rename(new, folder(border))
            fs.delete(back, True)
            if empty:
                fs.delete(new, True)
            rewritten.append(border)
    return {"removed": removed, "rewritten": rewritten}

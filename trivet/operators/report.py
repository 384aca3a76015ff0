"""Reports by owner and file."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivet.operators.clusters import written

_ITEM = ("pattern_name", "match_line_number", "is_credentials", "status", "confidence", "reasoning", "evidence", "json_valid", "value_hash")


def _named(decided: DataFrame) -> DataFrame:
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c)
    return decided.select(named("owner"), named("file_path"), *[c for c in decided.columns if c not in ("owner", "file_path")])


def owner_summary(decided: DataFrame) -> DataFrame:
    """Counts for each owner, aggregated before rows move; ``false_positive`` is what is neither REAL nor REVIEW."""
    s = F.col("status")
    total = F.count(F.lit(1))
    return _named(decided).groupBy("owner").agg(
        total.alias("total"),
        F.count_if(F.col("is_credentials") == 1).alias("credentials"),
        (total - F.count_if(F.col("is_credentials") == 1)).alias("non_credentials"),
        F.count_if(s == "REAL").alias("real"),
        F.count_if(s == "REVIEW").alias("review"),
        (total - F.count_if(s == "REAL") - F.count_if(s == "REVIEW")).alias("false_positive"),
        F.count_if(~F.col("json_valid")).alias("json_invalid"),
    )


def file_summary(decided: DataFrame) -> DataFrame:
    """Counts of owners, of files in owners, and of everything (``owner`` or ``file_path`` null)."""
    return _named(decided).rollup("owner", "file_path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_credentials") == 1).alias("credentials"))


def report_items(decided: DataFrame) -> DataFrame:
    """The report's detections, flat, written in parts by owner and file: the scalable form. Values are hashed."""
    from trivet.functions.text import value_hash

    rows = _named(decided).withColumn("value_hash", value_hash(F.col("matched_value"))).withColumn("confidence", F.bround("confidence", 2))
    return rows.select("owner", "file_path", *_ITEM)


def nested_report(decided: DataFrame, most: int = 20_000) -> DataFrame:
    """``owner, part, summary, files map<path, array<detection>>``, every detection once, detections of a file in order of pattern,
    line and hash. A part has ``most`` detections at most, so an owner of many files and a file of many detections, equal ones too,
    go over several parts; most owners have part 0 only. Each part has its owner's ``summary``.

    No owner and no file is brought together: rows are sorted by range, with a salt behind all else, and each task cuts its
    sorted rows into parts as they pass. Parts of an owner are then numbered by counts, a row for each owner of a task.
    """
    item = F.struct(*_ITEM).alias("item")
    order = ["owner", "file_path", "pattern_name", "match_line_number", "value_hash", "_salt"]
    rows = report_items(decided).withColumn("_salt", F.monotonically_increasing_id())
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("owner", "file_path", item)
    kind = laid.schema["item"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        owner, file, seq, count, held = None, None, -1, 0, 0
        owners, seqs, files, names, sizes, items = [], [], [], [], [], []

        def flush() -> pa.RecordBatch:
            ends = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
            lists = pa.ListArray.from_arrays(ends(sizes), pa.concat_arrays(items))
            maps = pa.MapArray.from_arrays(ends(files), pa.array(names, pa.string()), lists)
            out = pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array([task] * len(owners), pa.int32()), pa.array(seqs, pa.int64()), maps], ["owner", "task", "seq", "files"])
            for column in (owners, seqs, files, names, sizes, items):
                column.clear()
            return out

        for batch in batches:
            who, where = batch.column("owner").to_numpy(zero_copy_only=False), batch.column("file_path").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((who[1:] != who[:-1]) | (where[1:] != where[:-1])) + 1
            for a, b in pairwise([0, *cuts.tolist(), len(who)]):
                while a < b:
                    new = who[a] != owner
                    if new or count >= most:
                        seq, count = 0 if new else seq + 1, 0
                        if held >= most or len(owners) >= 1_000:
                            yield flush()
                            held = 0
                        owners.append(who[a])
                        seqs.append(seq)
                        files.append(0)
                    if new or count == 0 or where[a] != file:
                        names.append(where[a])
                        sizes.append(0)
                        files[-1] += 1
                    owner, file = who[a], where[a]
                    n = min(b - a, most - count)
                    items.append(batch.column("item").slice(a, n))
                    sizes[-1] += n
                    a, count, held = a + n, count + n, held + n
        if owners:
            yield flush()

    cut = written(laid.mapInArrow(parts, f"owner string, task int, seq bigint, files map<string,array<{kind}>>"))
    counts = cut.groupBy("owner", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    summary = owner_summary(decided)
    packed = summary.select("owner", F.struct(*[c for c in summary.columns if c != "owner"]).alias("summary"))
    starts = counts.select("owner", "task", F.coalesce(before, F.lit(0)).alias("start")).join(packed, "owner")
    return cut.join(starts, ["owner", "task"]).select("owner", (F.col("start") + F.col("seq")).alias("part"), "summary", "files")

"""Sinks: JSON lines, previews, reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivet.functions.text import preview
from trivet.sources.batches import small_batches


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Fields that are null are written too."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def inspection(records: DataFrame) -> DataFrame:
    """Eight columns for people to read."""
    return records.select(
        "record_id",
        "status",
        "is_credentials",
        F.coalesce(F.nullif("distractor_type", F.lit("")), F.lit("original")).alias("distractor_type"),
        "username",
        F.coalesce(F.nullif(preview(F.col("password"), 40), F.lit("")), F.lit("None")).alias("password"),
        F.format_string("%.3f", "features.entropy").alias("entropy"),
        preview(F.col("context"), 120).alias("context"),
    )


def write_inspection(records: DataFrame, path: str, head: int | None = None, order_col: str = "record_id") -> None:
    """CSV of all records, or of the first ``head`` by id."""
    rows = inspection(records)
    if head:
        rows = rows.orderBy(order_col).limit(head)
    rows.write.csv(path, header=True, quoteAll=True, escape='"')


def instruction_rows(pairs: DataFrame, instruction: str) -> DataFrame:
    return pairs.select(F.lit(instruction).alias("instruction"), F.col("prompt").alias("input"), F.col("completion").alias("output"))


def small_json(rows: DataFrame, most: int = 10_000) -> str:
    """A report of few rows as JSON text; more than ``most`` rows are an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in got], indent=2, ensure_ascii=False, default=str)


def write_framed(rows: DataFrame, path: str, head: str, tail: str, between: str = ",", spell: Callable[..., str] = str) -> None:
    """Rows as files that are whole by themselves: a head, a line for each row with ``between`` after all but the last, and a tail. A
    line is ``spell`` of the row's columns. Each task writes its own file line by line, so no file is put together in one place."""

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda values: pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})
        yield lines([head])
        held = []
        for batch in batches:
            now = held + [spell(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            held = now[-1:]
            yield lines([line + between for line in now[:-1]])
        yield lines([*held, tail])

    with small_batches(rows.sparkSession):
        rows.mapInArrow(frame, "value string").write.text(path)


def write_tuples(rows: DataFrame, path: str, title: str = "labelled findings") -> None:
    """``context, username, password`` as tuple files, which :func:`trivet.sources.readers.read_tuples` reads."""
    write_framed(rows.select("context", "username", "password"), path, f"# {title}\ndataset = [", "]", spell=lambda *row: f"    {row!r}")


def write_json_array(rows: DataFrame, path: str) -> None:
    """Files that each hold one JSON array; nulls are written too."""
    write_framed(rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")), path, "[", "]")


def append_missing(rows: DataFrame, done: DataFrame | None, path: str, id_col: str = "record_id") -> None:
    """Append rows whose id an earlier run has not written."""
    todo = rows if done is None else rows.join(done, id_col, "left_anti")
    write_json_lines(todo, path, mode="append")


def guard_output(source: str, target: str) -> None:
    """Refuse to write into the folder that is read."""
    if target.rstrip("/") == source.rstrip("/") or target.startswith(source.rstrip("/") + "/"):
        raise ValueError(f"{target} is inside the source folder {source}")

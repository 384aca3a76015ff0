"""Sources: labelled tuple files, detections, JSON lines, rationales, finished ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet import schema
from trivet.sources.json_arrays import read_elements
from trivet.sources.tuple_files import read_tuples  # noqa: F401  one of the sources

def read_detections(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Detections from JSON arrays of any size (``multi_line``) or lines; a byte order mark is no hindrance. Missing fields are null."""
    if multi_line:
        return read_elements(spark, path, schema.DETECTION)
    text = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).filter("length(trim(value)) > 0")
    return text.select(F.inline(F.from_json("value", f"array<struct<{schema.DETECTION}>>")))


def read_json_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """JSON lines of a schema. Blank lines are skipped, broken ones give no row."""
    rows = spark.read.schema(f"{fields}, _broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    names = [c for c in rows.columns if c != "_broken"]
    return rows.filter(F.col("_broken").isNull()).select(*names)


def read_rationales(spark: SparkSession, path: str) -> DataFrame:
    """The last rationale of each record, in the order of files and lines; lines without an id are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = lines.select("f", "b", "i", F.from_json("value", schema.RATIONALE).alias("r")).filter("length(r.record_id) > 0")
    return rows.groupBy("r.record_id").agg(F.max_by("r", F.struct("f", "b", "i")).alias("r")).select("record_id", "r.reasoning", "r.evidence")


def read_done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids that an output already has; broken lines are ignored."""
    return read_json_lines(spark, path, "record_id string").filter("length(record_id) > 0").distinct()


def first_existing(spark: SparkSession, folder: str, stem: str) -> str:
    """``stem``, then ``stem (1)``, then the first file by name that begins so; an error that names the place otherwise."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(base)) if fs.exists(base) else []
    for want in (stem, f"{stem} (1)"):
        hit = [n for n in names if n == want or n.rsplit(".", 1)[0] == want]
        if hit:
            return f"{folder}/{hit[0]}"
    rest = [n for n in names if n.startswith(stem)]
    if not rest:
        raise FileNotFoundError(f"no file {stem!r} in {folder}")
    return f"{folder}/{rest[0]}"

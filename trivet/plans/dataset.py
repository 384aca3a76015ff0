"""From labelled tuples to splits and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.operators import augment, metrics, records
from trivet.operators.clusters import written
from trivet.plans import artifacts
from trivet.sources import readers, writers

INSTRUCTION = "Decide whether the detected value is a real credential and answer with one JSON object."


def merged(true_positives: DataFrame, false_positives: DataFrame, reviews: DataFrame | None = None, per_parent: int = 3, seed: int = 42) -> DataFrame:
    """Records of all labels and variants of the false positives, one of each key."""
    true_positives, false_positives = written(true_positives), written(false_positives)  # read again for the pool and for variants
    pool = written(augment.password_pool(true_positives))
    every = true_positives.unionByName(false_positives)
    if reviews is not None:
        every = every.unionByName(reviews)
    if per_parent > 0:
        every = every.unionByName(augment.augment_false_positives(false_positives, pool, per_parent, seed))
    return records.first_of_key(every, seed=seed)


def merge_report(rows: DataFrame) -> dict[str, dict[str, int]]:
    """Counters by status, flag and distractor: a few rows each."""
    pairs = {"status": None, "is_credentials": None, "distractor_type": "original"}
    return {col: {r["value"]: r["count"] for r in metrics.value_counts(rows, col, default).collect()} for col, default in pairs.items()}


def build(
    spark: SparkSession,
    true_path: str,
    false_path: str,
    review_path: str | None,
    out: str,
    per_parent: int = 3,
    cap: int = 0,
    seed: int = 42,
    rationales: str | None = None,
) -> dict:
    """Read, merge, cap, split, check, pair and write; returns the report. All sources that are missing are named in one error. The merged
    records are written once and every artifact is made from that table; artifacts appear together when all are written, and
    take the place of an earlier build's (:func:`trivet.plans.artifacts.artifact` gives their paths)."""
    writers.guard_output(true_path.rsplit("/", 1)[0], out)
    artifacts.require(spark, {"REAL": true_path, "FALSE_POSITIVE": false_path, "REVIEW": review_path, "rationales": rationales})
    read = lambda path, status: records.make_records(readers.read_tuples(spark, path), status)
    rows = written(merged(read(true_path, "REAL"), read(false_path, "FALSE_POSITIVE"), read(review_path, "REVIEW") if review_path else None, min(max(per_parent, 0), 3), seed))
    split = written(records.assign_splits(records.cap_per_class(rows, cap, seed), seed=seed))
    leaks = records.leaked_groups(split).limit(5).collect()
    if leaks:
        raise AssertionError(f"groups in several splits: {[r[0] for r in leaks]}")
    why = readers.read_rationales(spark, rationales) if rationales else None
    pairs = written(records.prompt_pairs(split, why).join(split.select("record_id", "split"), "record_id"))
    made = artifacts.Build(spark, out)
    writers.write_json_lines(rows, made.path("merged_records"))
    for name in ("train", "validation", "test"):
        part = pairs.filter(F.col("split") == name).drop("split")
        writers.write_json_lines(part, made.path(name))
        writers.write_inspection(split.filter(F.col("split") == name), made.path(f"{name}_inspection"))
    writers.write_inspection(rows, made.path("merged_inspection"))
    writers.write_inspection(rows, made.path("merged_head"), head=500)
    writers.write_json_array(writers.instruction_rows(pairs, INSTRUCTION), made.path("instructions"))
    report = merge_report(rows) | {"splits": {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}}
    made.publish(report=report)
    return report

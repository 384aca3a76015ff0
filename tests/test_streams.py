"""Streams with state against what a batch says about all rows."""

import random

from pyspark.sql import functions as F

from trivet.functions.text import value_hash
from trivet.streaming import triage as streams

SCHEMA = "event_id long, ts timestamp, matched_value string, status string, json_valid boolean, latency double"


def stream(spark, tmp_path, parts, make, name):
    """Files, one a batch, written in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = make(streams.read_stream(spark, str(tmp_path / "in"), SCHEMA, files=1))
    query = streams.write_stream(rows, str(tmp_path / name), str(tmp_path / f"{name}-state"))
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name)), query


def row(spark, i, second, value, latency=None):
    from datetime import UTC, datetime

    return (i, datetime.fromtimestamp(1_700_000_000 + second, UTC), value, "REAL" if i % 3 else "REVIEW", i % 5 != 0, latency)


def test_first_by_time_in_many_batches(spark, tmp_path):
    """One value has 12,000 rows of one batch; earlier rows come in later batches; times tie; some rows are repeated."""
    rng = random.Random(4)
    rows = [row(spark, i, rng.randint(0, 5000), "hot") for i in range(12_000)] + [row(spark, 20_000 + i, rng.randint(0, 300), rng.choice(["a", "b", None, "", "c"])) for i in range(600)]
    rng.shuffle(rows)
    parts = [rows[:300], rows[300:12_400], rows[12_400:], [row(spark, -1, 10_000_000, "end")]]
    got, _ = stream(spark, tmp_path, parts, lambda d: streams.mark_duplicates(d, "ts", late="100 days"), "out")
    table = spark.createDataFrame([r for p in parts[:3] for r in p], SCHEMA).withColumn("value_hash", value_hash(F.col("matched_value"))).filter("value_hash IS NOT NULL")
    first = {r.value_hash: r.m[1] for r in table.groupBy("value_hash").agg(F.min(F.struct("ts", "event_id")).alias("m")).collect()}
    out = got.collect()
    assert sorted(r.id for r in out) == sorted(r.event_id for r in table.collect())
    assert all(r.is_duplicate == (first[r.value_hash] != r.id) for r in out)


def test_told_with_the_batch_and_forgotten(spark, tmp_path):
    parts = [[row(spark, 2, 50, "v"), row(spark, 1, 50, "v"), row(spark, 3, 40, "w")], [row(spark, 4, 10, "v")], [row(spark, 5, 4000, "x")], [row(spark, 6, 5000, "v"), row(spark, 7, 5001, "v")]]
    got, _ = stream(spark, tmp_path, parts, lambda d: streams.mark_duplicates(d, "ts", late="1 minute", wait=False, forget=1_000_000), "out")
    out = {r.id: r.is_duplicate for r in got.collect()}
    assert out == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_sketches_merge_and_counters_are_reported(spark, tmp_path):
    rng = random.Random(9)
    values = [rng.lognormvariate(3, 1) for _ in range(6000)]
    rows = [row(spark, i, i % 7200, "v", v) for i, v in enumerate(values)] + [row(spark, 9000, 5, "v", None)]
    parts = [rows[::2], rows[1::2], [row(spark, -1, 10_000_000, "end")]]
    got, query = stream(spark, tmp_path, parts, lambda d: streams.window_sketches(streams.observed(d), "ts", "latency", "5 minutes", "100 days"), "out")
    wide = streams.merged_quantiles(got, "1 day", (50, 95)).collect()
    every = sorted(values)
    assert sum(r.n for r in wide) == 6000
    (r,) = wide
    rank = lambda x: sum(v <= x for v in every) / 6000
    assert abs(rank(r.p50) - 0.5) < 0.05 and abs(rank(r.p95) - 0.95) < 0.05 and abs(r["mean"] - sum(values) / 6000) < 1e-6
    told = [p["observedMetrics"]["decisions"] for p in query.recentProgress if "decisions" in p["observedMetrics"]]
    assert sum(m["n"] for m in told) == 6002 and sum(m["json_invalid"] for m in told) == sum(r[0] % 5 == 0 for p in parts for r in p)

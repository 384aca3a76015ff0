"""Investigations, similar vectors, tool effects, retention, artifacts and token counts."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from trivet.functions import tokens
from trivet.operators import investigate, metrics, similar, triage
from trivet.plans import artifacts, dataset
from trivet.sources import daily


def test_most_similar_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "QUERY_ROWS", 7)
    monkeypatch.setattr(similar, "POOL_ROWS", 11)
    rng = random.Random(5)
    vectors = {i: [float(rng.randint(-3, 3)) for _ in range(4)] for i in range(90)}
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([*vectors.items(), *odd], "id long, vector array<double>")
    pool = table.filter("id % 3 <> 0").withColumnRenamed("id", "example_id")
    got = {r.id: [(x.example_id, x.score) for x in r.examples] for r in similar.most_similar(table.filter("id % 3 = 0 OR id >= 100"), pool, 5).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    usable = {i: v for i, v in vectors.items() if any(v)}
    assert set(got) == {i for i in vectors if i % 3 == 0} | {100, 101, 102, 103, 104}
    for i, found in got.items():
        every = sorted((-round(cosine(usable[i], v), 9), j) for j, v in usable.items() if j % 3) if i in usable else []
        assert [round(s, 9) for _, s in found] == [-s for s, _ in every[:5]]
        assert all((-round(s, 9), j) in every for j, s in found)
    assert similar.most_similar(table.limit(0), pool, 2).count() == 0
    assert [r.examples for r in similar.most_similar(table.filter("id = 1"), pool.limit(0), 2).collect()] == [[]]


def finding(spark, rows):
    return spark.createDataFrame([(i, "f", "s", "P", "v", c) for i, c in rows], "id long, file_path string, source string, pattern_name string, matched_value string, context string")


def test_investigation_keeps_the_best_paths(spark):
    """A model whose evidence for TEST_ONLY holds only behind ROTATED; each distinct path is asked once."""

    def fn(prompt, *_):
        path = prompt.split("Hypothesis: ")[1].split("\n")[0].split(" > ")
        words = {"REAL": ["alpha", "nowhere"], "ROTATED": ["beta"], "TEST_ONLY": ["gamma"] if "ROTATED" in path else ["nothing"]}.get(path[-1], [])
        return '{"reasoning": "x", "evidence": [' + ", ".join(f'"{w}"' for w in words) + "]}"

    rows = finding(spark, [(1, "alpha beta gamma"), (2, "alpha only"), (3, None), (4, "alpha beta gamma")])
    got = {r.id: r for r in investigate.investigate(rows, "id", triage.callable_provider(fn)).collect()}
    assert [(p.hypothesis, p.score) for p in got[1].path] == [("ROTATED", 1.0), ("TEST_ONLY", 1.0)] and got[1].status == "REVIEW" and got[1].score == 1.0
    assert (got[2].hypothesis, got[2].status, got[2].path[0].score) == ("REAL", "REAL", 0.5)
    assert (got[3].hypothesis, got[3].score) == ("REAL", 0.0) and got[4].path == got[1].path
    assert investigate.investigate(rows.limit(0), "id").count() == 0


def test_only_disagreements_are_investigated(spark):
    d = "struct<is_credentials:int,status:string,confidence:double>"
    voted = finding(spark, [(1, "rotated, expired, revoked"), (2, "rotated")]).withColumn("decision", F.lit(None).cast(d))
    voted = voted.withColumn("decision", F.struct(F.lit(1).alias("is_credentials"), F.lit("REAL").alias("status"), F.lit(0.5).alias("confidence")))
    voted = voted.withColumn("sample_statuses", F.when(F.col("id") == 1, F.array(F.lit("REAL"), F.lit("REVIEW"))).otherwise(F.array(F.lit("REAL"))))
    got = {r.id: r for r in investigate.settle_disagreements(voted, "id").collect()}
    assert (got[1].decision.status, got[1].decision.is_credentials, got[1].investigated) == ("REVIEW", 0, True)
    assert (got[2].decision.status, got[2].decision.is_credentials, got[2].investigated) == ("REAL", 1, False)


def test_calls_between_decisions(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    calls = spark.createDataFrame([("a", t(5), 10, "x", 1.0), ("a", t(5000), 11, "x", 3.0), ("a", t(1), 12, "y", 5.0), ("b", t(1), 13, "x", None), (None, t(1), 14, "y", 1.0)], "k string, at timestamp, id long, tool string, latency_ms double")
    decisions = spark.createDataFrame([("a", t(5), 1, "REAL"), ("a", t(5), 2, "REVIEW"), ("a", t(9000), 3, "REAL"), ("a", t(6), 4, None), (None, t(2), 5, "REAL")], "k string, at timestamp, id long, status string")
    got = {r.id: (r.before, r.after) for r in metrics.asof_decisions(calls, decisions, "k", "at", "id", "1 hour").collect()}
    assert got == {10: ("REVIEW", "REAL"), 11: ("REVIEW", "REAL"), 12: (None, "REAL"), 13: (None, None), 14: (None, "REAL")}
    effects = {r.tool: r for r in metrics.tool_effects(metrics.asof_decisions(calls, decisions, "k", "at", "id")).collect()}
    assert (effects["x"].calls, effects["x"].avg_latency_ms, effects["x"].changed_rate, effects["x"].review_resolved_rate) == (3, 2.0, 1.0, 1.0)
    assert (effects["y"].calls, effects["y"].changed_rate) == (2, None)


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_expiry_leaves_later_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)) for i in range(40)] + [(99, None)]
    daily.write_daily(spark.createDataFrame(rows, "id long, at timestamp_ntz"), "at", path)
    before = files_of(path)
    now = dt.datetime(2024, 2, 4, 12)
    assert daily.expire_daily(spark, path, "at", now) == {"removed": [f"2024-01-0{d}" for d in range(1, 5)], "rewritten": ["2024-01-05"]}
    left = spark.read.schema("id long, at timestamp_ntz").parquet(path)
    assert sorted(r.id for r in left.collect()) == [i for i, t in rows if t is None or t >= now - dt.timedelta(days=30)]
    after = files_of(path)
    assert {p: m for p, m in before.items() if p in after} == {p: m for p, m in after.items() if "day=2024-01-05" not in p}
    assert daily.expire_daily(spark, path, "at", now) == {"removed": [], "rewritten": []}
    (tmp_path / "t" / "day=2024-01-06").rename(tmp_path / "t" / "_old_2024-01-06_x")  # a run that ended between its two renames
    assert daily.expire_daily(spark, path, "at", now) == {"removed": [], "rewritten": []}
    assert sorted(r.id for r in spark.read.schema("id long, at timestamp_ntz").parquet(path).collect()) == [i for i, t in rows if t is None or t >= now - dt.timedelta(days=30)]
    assert daily.expire_daily(spark, path, "at", dt.datetime(2030, 1, 1))["removed"][0] == "2024-01-05" and spark.read.schema("id long").parquet(path).count() == 1


def test_half_a_build_is_never_seen(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    (source / "tp.txt").write_text("dataset = [('key=abcDEF123!', None, 'abcDEF123!')]")
    (source / "fp.txt").write_text("dataset = [('policy text', None, None)]")
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="REVIEW: .*rv.txt; rationales: .*why"):
        dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", f"{source}/rv.txt", out, rationales=f"{source}/why")
    with pytest.raises(FileNotFoundError):
        artifacts.artifact(spark, out, "train")
    whole = dataset.writers.write_json_array

    def ends(*_):
        raise RuntimeError("the cluster is gone")

    monkeypatch.setattr(dataset.writers, "write_json_array", ends)
    with pytest.raises(RuntimeError):
        dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", None, out, per_parent=0)
    with pytest.raises(FileNotFoundError):
        artifacts.manifest(spark, out)
    monkeypatch.setattr(dataset.writers, "write_json_array", whole)
    dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", None, out, per_parent=0)
    first = artifacts.manifest(spark, out)
    assert spark.read.json(artifacts.artifact(spark, out, "merged_records")).count() == 2
    monkeypatch.setattr(dataset.writers, "write_json_array", ends)
    with pytest.raises(RuntimeError):
        dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", None, out)
    assert artifacts.manifest(spark, out) == first and spark.read.json(artifacts.resolved(spark, f"{out}/merged_records")).count() == 2
    monkeypatch.setattr(dataset.writers, "write_json_array", whole)
    dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", None, out)
    now = artifacts.manifest(spark, out)
    assert now["build"] != first["build"] and now["report"]["status"]["FALSE_POSITIVE"] == 4
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("build-")] == [now["build"]]


def test_token_counts_equal_longest_matches(spark):
    rng = random.Random(1)
    pieces = ["a", "ab", "abc", "bca", "ca", "é🙂", " the", "", "cc"]

    def brute(text):
        n = 0
        while text:
            text = text[max([len(p) for p in pieces if p and text.startswith(p)], default=1) :]
            n += 1
        return n

    texts = [None, "", "é🙂é", "zzz", *["".join(rng.choices("abcé🙂 the", k=rng.randint(1, 60))) for _ in range(200)]]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.n for r in table.select("id", tokens.counter(spark, pieces)(F.col("t")).alias("n")).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    rows = spark.createDataFrame([("m", "s", "abcab", "zz"), ("m", "s", "a", None)], "model string, strategy string, prompt string, raw_response string")
    (r,) = metrics.answer_rates(rows, tokens.counter(spark, pieces)).collect()
    assert (r.prompt_tokens, r.answer_tokens) == (1.5, 1.0)

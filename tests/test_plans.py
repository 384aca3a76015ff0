import http.server
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from trivet.operators import clusters, metrics, records, report, synth, triage
from trivet.plans import artifacts, benchmark, dataset
from trivet.sources import readers, writers
from trivet.streaming import triage as streams


def tuples_file(path, rows):
    path.write_text("# labelled\ndataset = [\n" + "".join(f"    ({c!r}, {u!r}, {p!r}),\n" for c, u, p in rows) + "]\n")


def test_tuple_files(spark, tmp_path):
    tuples_file(tmp_path / "a.txt", [("ctx\n\"q\" \\ x", "u", "p"), ("c2", None, None)])
    (tmp_path / "b.txt").write_text('broken ( """one\ntwo""", None, "pw" ), ("""z""", \'u\', x1 ) =')
    (tmp_path / "c.txt").write_text("dataset = [(1, 2), ('only', 'three', 'kept', 'first')]")
    got = sorted(tuple(r) for r in readers.read_tuples(spark, str(tmp_path)).collect())
    assert got == sorted([("a.txt", 1, 'ctx\n"q" \\ x', "u", "p"), ("a.txt", 2, "c2", None, None), ("b.txt", 1, "one\ntwo", "None", '"pw"'), ("b.txt", 2, "z", "'u'", "x1 "), ("c.txt", 1, "only", "three", "kept")], key=lambda r: r)
    assert {r.source_file for r in readers.read_tuples(spark, str(tmp_path), fallback=False).collect()} == {"a.txt", "c.txt"}


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([{"file_path": "a", "matched_value": "v", "context": "c"}]).encode())
    assert [r.matched_value for r in readers.read_detections(spark, str(tmp_path / "d.json")).collect()] == ["v"]
    (tmp_path / "r.jsonl").write_text('{"record_id": "1", "reasoning": "a", "evidence": []}\n\nnot json\n{"record_id": "1", "reasoning": "b", "evidence": ["e"]}\n{"reasoning": "x"}\n')
    assert [tuple(r) for r in readers.read_rationales(spark, str(tmp_path / "r.jsonl")).collect()] == [("1", "b", ["e"])]
    assert [r.record_id for r in readers.read_done_ids(spark, str(tmp_path / "r.jsonl")).collect()] == ["1"]
    (tmp_path / "set (1).txt").write_text("x")
    assert readers.first_existing(spark, str(tmp_path), "set").endswith("set (1).txt")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path), "missing")


def test_build_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = synth.generate(spark, 60, 60, 20, seed=5).collect()
    for label, name in (("REAL", "tp"), ("FALSE_POSITIVE", "fp"), ("REVIEW", "rv")):
        tuples_file(source / f"{name}.txt", [(r.context, r.username, r.password) for r in rows if r.label == label])
    out = str(tmp_path / "out")
    done = dataset.build(spark, *[f"{source}/{n}.txt" for n in ("tp", "fp", "rv")], out)
    assert done["status"]["REAL"] == 60 and done["status"]["REVIEW"] == 20 and done["status"]["FALSE_POSITIVE"] > 200
    merged = spark.read.json(artifacts.artifact(spark, out, "merged_records"))
    assert merged.filter("augmentation_parent_id IS NOT NULL AND is_credentials <> 0").isEmpty()
    assert sum(spark.read.json(artifacts.artifact(spark, out, n)).count() for n in ("train", "validation", "test")) == merged.count()
    assert spark.read.csv(artifacts.artifact(spark, out, "merged_head"), header=True, multiLine=True, escape='"').count() == min(500, merged.count())
    with pytest.raises(ValueError):
        dataset.build(spark, f"{source}/tp.txt", f"{source}/fp.txt", None, f"{source}/out")


def test_splits_and_caps(spark):
    rows = spark.createDataFrame([(str(i), f"g{i % 37}", "AB"[i % 3 == 0]) for i in range(500)], "record_id string, source_context_hash string, status string")
    split = records.assign_splits(rows)
    groups = split.select("source_context_hash", "split").distinct().groupBy("split").count().collect()
    assert {r.split: r["count"] for r in groups} == {"test": 3, "validation": 3, "train": 31}
    assert records.leaked_groups(split).isEmpty() and records.assign_splits(rows.limit(0)).count() == 0
    assert {r.status: r["count"] for r in records.cap_per_class(rows, 50).groupBy("status").count().collect()} == {"A": 50, "B": 50}
    assert records.cap_per_class(rows, 0).count() == 500


def test_nearest_rank_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([1.0, 2.0, rng.random() * 100])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 300))] + [("c", 5.0)]
    got = {(r.g, r.percent): r.value for r in metrics.nearest_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0, 37, 50, 95, 100]).collect()}
    for g in ("a", "b", None, "c"):
        xs = sorted(x for k, x in rows if k == g and x is not None)
        for q in (0, 37, 50, 95, 100):
            assert got[g, float(q)] == xs[min(len(xs) - 1, round(q / 100 * (len(xs) - 1)))]


def test_providers_and_strategies(spark):
    def model(prompt, system, name, temperature):
        if "Match: failing-call" in prompt:
            raise RuntimeError
        if "ReAct" in system or "tool" in system and "{\"action\"" in system:
            return '{"action": "no_such_tool"}'
        return '{"status": "REVIEW", "confidence": 0.5, "reasoning": "r", "evidence": []}' if temperature == 0 else '{"status": "REAL", "is_credentials": 1, "confidence": 0.9, "reasoning": "r", "evidence": []}'

    cols = "id long, file_path string, owner string, source string, pattern_name string, matched_value string, match_line_number int, context string"
    rows = spark.createDataFrame([(1, "a", "o", "s", "P", "failing-call", 1, "c"), (2, "a", None, "s", "P", "Zk3!mQ8$vT1&", 2, "c"), (3, "a", "", "s", "P", None, 3, "c"), (4, "b", "o", "s", "P", "aaaa", None, None)], cols)
    provider = triage.callable_provider(model)
    got = {r.id: r for r in triage.classify(rows, provider).collect()}
    assert got[3].skipped_model and got[4].skipped_model and not got[1].skipped_model
    assert got[1].decision.evidence == ["llm_error"] and not got[1].decision.json_valid
    voted = {r.id: r for r in triage.self_consistency(rows, "id", provider).collect()}
    assert voted[2].escalated and voted[2].votes_real == 4 and voted[2].decision.status == "REAL" and len(voted[2].sample_statuses) == 5
    loop = {r.id: r for r in triage.react(rows, provider, provider).collect()}
    assert loop[2].terminated == "fallback_direct_json" and loop[2].steps == 1
    own = {r.id: r for r in triage.react(rows).collect()}
    assert own[2].terminated == "final" and [c.tool for c in own[2].tool_calls] == ["placeholder_check", "context_signal_check"]
    summary = {r.owner: r for r in report.owner_summary(triage.flat(triage.classify(rows))).collect()}
    assert summary["unknown"].total == 2 and summary["o"].total == 2
    nested = {r.owner: r for r in report.nested_report(triage.flat(triage.classify(rows))).collect()}
    assert set(nested["o"].files) == {"a", "b"} and len(nested["o"].files["a"]) == 1
    assert triage.classify(rows.limit(0)).count() == 0


def test_benchmark_evaluate_distill(spark):
    cases = benchmark.smoke_cases(spark)
    rows = benchmark.bench_rows(cases, {"native": triage.native_provider}, ("direct_json", "tool_assisted"))
    summary = {r.strategy: r for r in metrics.benchmark_summary(rows).collect()}
    assert summary["direct_json"].n == 7 and summary["direct_json"].recall == 0.5
    pairs = cases.select("record_id", F.lit("p").alias("prompt"), "status", "is_credentials", F.lit("{}").alias("completion"))
    answered = benchmark.timed(lambda p: '{"status": "REAL"}')(pairs)
    scored = benchmark.evaluate(answered)
    assert scored.filter("predicted_binary = 1 AND latency_ms >= 0 AND json_valid AND NOT schema_valid").count() == 7
    teacher = triage.callable_provider(lambda p, s, m, t: '{"reasoning": "because", "evidence": "one"}')
    done = pairs.select("record_id").limit(2)
    out = benchmark.distill(pairs, teacher, "t", done).collect()
    assert len(out) == 5 and out[0].evidence == ["one"]
    arrays = benchmark.training_arrays(pairs, lambda s: [ord(c) for c in s], length=6).first()
    assert arrays.input_ids == [112, 10, 123, 125, 0, 0] and arrays.labels == [-100, -100, 123, 125, -100, -100] and arrays.attention_mask == [1, 1, 1, 1, 0, 0]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", None), ("2", "é")], "record_id string, x string")
    writers.append_missing(rows, None, str(tmp_path / "o"))
    writers.append_missing(rows.union(rows.selectExpr("'3'", "x")), readers.read_done_ids(spark, str(tmp_path / "o")), str(tmp_path / "o"))
    assert sorted(r.record_id for r in spark.read.json(str(tmp_path / "o")).collect()) == ["1", "2", "3", "3"]
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    assert json.loads(writers.small_json(rows)) == [{"record_id": "1", "x": None}, {"record_id": "2", "x": "é"}]


def test_generator(spark):
    rows = synth.generate(spark, 120, 120, 30, seed=8).collect()
    assert len({r.context for r in rows}) == 270 and all(len(r.context) <= 512 for r in rows)
    for r in rows:
        assert (r.password is not None) == (r.label != "FALSE_POSITIVE")
        if r.label != "FALSE_POSITIVE" and len(r.context) < 512:
            assert r.password in r.context, r
    assert sorted(map(str, rows)) == sorted(map(str, synth.generate(spark, 120, 120, 30, seed=8).repartition(3).collect()))


def test_mined_words_reach_findings(spark):
    texts = spark.createDataFrame([("see a.red.example and b.red.example, BLUE\\ann, FIX-1234, MAIN_KEY = 1",), (None,), ("",)], "text string")
    words = synth.mine_vocabulary(texts)
    assert {(r.kind, r.value, r.n) for r in words.collect()} == {("domain", "red.example", 1), ("account", "BLUE", 1), ("ticket", "FIX", 1), ("name", "MAIN_KEY", 1)}
    rows = synth.generate(spark, 60, 60, 0, seed=3, vocabulary=words).collect()
    every = " ".join(r.context for r in rows)
    assert "red.example" in every and "MAIN_KEY" in every and "FIX-" in every and "BLUE" in every and "lab.example" not in every
    assert synth.mine_vocabulary(texts.limit(0)).count() == 0 and synth.generate(spark, 5, 5, 5, vocabulary=words.limit(0)).count() == 15


def test_clusters(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", None), (5, None, None)], "id long, p string, q string")
    assert {r.id: r.cluster for r in clusters.entity_clusters(rows, "id", ("p", "q")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_clusters_of_long_chains(spark):
    """Rows 1, n, n - 1, ..., 2 share a value with their neighbours in this order."""
    n = 130
    chain = [1, *range(n, 1, -1)]
    rows = spark.createDataFrame([(i, k // 2, (k + 1) // 2) for k, i in enumerate(chain)] + [(500, None, None)], "id long, p long, q long")
    got = {r.id: r.cluster for r in clusters.entity_clusters(rows, "id", ("p", "q")).collect()}
    assert got == {i: 1 for i in chain} | {500: 500}


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", f"v{i % 3}", "o") for i in range(12)]
    data = spark.createDataFrame(rows, "event_id long, t string, matched_value string, owner string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    for k in range(2):
        data.filter(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, matched_value string, owner string, ts timestamp"
    q = streams.write_stream(streams.mark_duplicates(streams.read_stream(spark, str(tmp_path / "in"), schema, files=1), "ts", wait=False), str(tmp_path / "dup"), str(tmp_path / "c1"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "dup"))
    assert got.count() == 12 and got.filter("NOT is_duplicate").count() == 3
    q = streams.write_counts(streams.owner_sessions(streams.read_stream(spark, str(tmp_path / "in"), schema), "ts", "owner"), str(tmp_path / "s"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert [r.n for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [12]


def test_calls_repeat_after_failures_and_answers_without_an_object(spark):
    seen = {}

    def model(prompt, system, name, temperature):
        n = seen[prompt] = seen.get(prompt, 0) + 1
        kind = prompt.split("Match: ")[1].split("\n")[0]
        if kind == "fails-once" and n == 1:
            raise RuntimeError
        if kind == "fails" or kind == "text-only":
            return "no object" if kind == "text-only" else 1 / 0
        return "no object yet" if kind == "text-once" and n == 1 else 'so: {"status": "REAL", "is_credentials": 1}'

    rows = spark.createDataFrame([(k, "f", "o", "s", "P", k, "c") for k in ("fails-once", "fails", "text-once", "text-only", "good")], "id string, file_path string, owner string, source string, pattern_name string, matched_value string, context string").coalesce(1)
    got = {r.id: (r.decision.status, r.decision.json_valid) for r in triage.ask(rows, triage.callable_provider(model)).collect()}
    assert got == {"fails-once": ("REAL", True), "fails": ("REVIEW", False), "text-once": ("REAL", True), "text-only": ("REVIEW", False), "good": ("REAL", True)}
    assert triage.has_object("a { b {}") and not triage.has_object("{ no") and not triage.has_object(None)


def test_model_over_http(tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["model"] == "slow":
                time.sleep(2)
            answer = json.dumps({"message": {"content": f"{asked['messages'][1]['content']} {self.headers.get('Authorization')}"}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = triage.http_model(f"http://127.0.0.1:{server.server_port}/chat", timeout=0.5, token="t")
    assert ask("hello", "sys", "m", 0.0) == "hello Bearer t"
    with pytest.raises(OSError):
        ask("hello", "sys", "slow", 0.0)
    server.shutdown()


def test_nested_report_deals_large_files_over_parts(spark):
    rows = spark.createDataFrame([(i, "o", "f", f"v{i}") for i in range(40)], "match_line_number int, owner string, file_path string, matched_value string")
    rows = rows.withColumns({"source": F.lit("s"), "pattern_name": F.lit("P"), "context": F.lit("c")})
    nested = report.nested_report(triage.flat(triage.classify(rows)), most=10).collect()
    lines = [x.match_line_number for r in nested for x in r.files["f"]]
    assert sorted(lines) == list(range(40)) and len(nested) > 1 and all(r.summary.total == 40 for r in nested)

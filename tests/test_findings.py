"""Cases that reviews have found, small enough to run each time."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from trivet import schema
from trivet.operators import investigate, synth
from trivet.plans import benchmark
from trivet.sources import json_arrays, readers, tuple_files, writers

DETECTION = "id long, file_path string, source string, pattern_name string, matched_value string, context string"


def test_paths_are_not_broadcast(spark):
    """Where a round's paths are written they are few bytes, however many rows they are."""
    rows = spark.createDataFrame([(i, f"docs/{i}", "s", "p", "v", "test mock fixture prod" if i % 2 else "example readme revoked") for i in range(20)], DETECTION)
    plans = []

    def provider(df, model, temperature):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return investigate.signs_provider(df, model, temperature)

    got = {r.id: (r.hypothesis, [p.hypothesis for p in r.path]) for r in investigate.investigate(rows, "id", provider).collect()}
    assert len(plans) == 2 and "Join" in plans[1] and not any("Broadcast" in p for p in plans)
    assert got == {i: ("TEST_ONLY", ["TEST_ONLY", "REAL"]) if i % 2 else ("DOCUMENTATION_EXAMPLE", ["DOCUMENTATION_EXAMPLE", "ROTATED"]) for i in range(20)}


ARRAYS = {
    "empty": "", "blank": " \n", "none": "[ \n ]\n", "one": ' {"file_path": "one"}\n', "cut": '{"file_path": "cut"', "mark": "\ufeff[{\"file_path\": \"mark\"}]", "null": '[null, {"file_path": "n"}]',
    "scalar": '[{"file_path": "s"}, 5]', "tail": '[{"file_path": "t"},]', "two": '[{"file_path": "a"} {"file_path": "b"}]', "behind": '[{"file_path": "behind"}] {"file_path": "x"}', "open": '[{"file_path": "o"}, ',
    "single": "[{'file_path': 'it}s \"'}]", "type": '[{"file_path": "type", "match_line_number": "x"}]', "wrong": '[{"file_path": "w"}}', "bad": '[{"file_path": "b"}, {"file_path": b}]', "lines": '{"file_path": "l1"}\n{"file_path": "l2"}',
    "nest": '[{"context": {"a": [1, {"b": "}"}]}, "owner": [1,2]}]', "arrays": '[[{"file_path": "na"}]]', "first": '[,{"file_path": "d"}]', "prose": 'x [{"file_path": "g"}]', "line in text": '[{"file_path": "a\nb"}]',
}


def test_json_arrays_are_read_in_blocks(spark, tmp_path, monkeypatch):
    """Every file as Spark reads its whole text, and no task has a whole file."""
    rng = random.Random(3)
    words = lambda n: "".join(rng.choices(["a", "{", "}", "[", "]", '"', "'", "\\", ",", "\u00e9", "\n", " "], k=rng.randint(0, n)))
    files = dict(ARRAYS)
    for k in range(4):
        rows = [{"file_path": f"r{k}", "owner": words(9), "matched_value": None, "match_line_number": i, "context": words(90)} for i in range(40)]
        files[f"r{k}"] = json.dumps(rows, ensure_ascii=bool(k % 2), indent=2 if k > 1 else None)
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).filter("length(trim(value)) > 0")
    want = whole.select(F.inline(F.from_json("value", f"array<struct<{schema.DETECTION}>>"))).collect()
    tables = []
    monkeypatch.setattr(json_arrays, "written", lambda df, f=json_arrays.written: tables.append(f(df)) or tables[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = readers.read_detections(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 160
    assert tables[1].filter("file LIKE '%r0.json'").select("block").distinct().count() > 5


def test_tuple_files_come_and_go_in_small_batches(spark, tmp_path, monkeypatch):
    """What a worker holds does not follow the length of texts."""

    def within(batches, inner):
        def small():
            for b in batches:
                if b.nbytes > 6 << 20 or b.num_rows > 500:
                    raise MemoryError(f"a batch of {b.nbytes} bytes")
                yield b

        for b in inner(small()):
            if b.nbytes > 6 << 20:
                raise MemoryError(f"{b.nbytes} bytes handed on")
            yield b

    for name in ("blocks_told", "parsed"):
        monkeypatch.setattr(tuple_files, name, lambda batches, inner=getattr(tuple_files, name): within(batches, inner))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(1500).selectExpr("concat(id, repeat(' text', 3000)) AS context", "'u' AS username", "nullif(concat('p', id), 'p7') AS password")
    writers.write_tuples(rows.coalesce(1), str(tmp_path / "t"))
    got = readers.read_tuples(spark, str(tmp_path / "t")).selectExpr("count(*)", "count(password)", "count(distinct context)", "min(length(context))", "max(source_index)").first()
    assert tuple(got) == (1500, 1499, 1500, 15001, 1500)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_stored_answer_is_parsed_once(spark):
    """The search for an object in a text is the dear part."""
    rows = spark.createDataFrame([("1", '{"status": "REAL", "is_credentials": 1}', 'so: {"status": "review", "is_credentials": 0}'), ("2", "FALSE_POSITIVE", None)], "record_id string, completion string, raw_response string")
    out = benchmark.evaluate(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    got = [tuple(r)[3:] for r in out.orderBy("record_id").collect()]
    assert got == [("REAL", "REVIEW", 1, 0, True, False), ("FALSE_POSITIVE", "REVIEW", 0, 0, False, False)]


def test_mined_words_are_those_of_the_sql(spark, tmp_path):
    """Beside letters beyond ASCII and a vertical tab, and in texts of very many labels, which took the JVM's stack."""
    rng = random.Random(11)
    parts = ["a", "b7", "com", "red.example", ".", "..", "-", "_", "A", "AB", "FIX", "MAIN_KEY", "BLUE", "\\", "1234", "56789", "=", ":", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\u00e9", "\u0416", "e\u0301", "\U0001d400", "\u200d", "\u00a0", "\u0661"]
    near = lambda x: rng.choice(parts) + x + rng.choice(parts)
    words = ["h.a1.com", "BLUE\\a", "FIX-1234", "MAIN_KEY ="]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(3000)] + [near(rng.choice(words)) + near(rng.choice(words)) for _ in range(3000)] + [None, "", "...", "....a.b.com....", "a.b.com-x1.c.d9", "a..b.com.d"]
    texts += ["a." * 30000 + "com", "a." * 30000, "a." * 30000 + "c1", "AB" + "_AB" * 30000 + "\x0c= 1", "A" * 100000, "\u00e9x." * 5000 + "x.net"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    found = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) AS value FROM '{tmp_path}/t/*.parquet'" for k, p in synth.MINED.items())
    want = duckdb.sql(f"SELECT kind, value, count(*) FROM ({found}) GROUP BY 1, 2").fetchall()
    got = [tuple(r) for r in synth.mine_vocabulary(rows).collect()]
    assert sorted(got) == sorted(want)
    assert {k for k, _, _ in got} == set(synth.MINED) and len(got) > 100 and max(len(v) for _, v, _ in got) > 60000

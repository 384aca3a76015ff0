"""Queries of sources, sinks and plans: tables are written in each format, read back, and compared with SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet import schema
from trivet.functions import jsonx, tokens, tools
from trivet.functions import text as T
from trivet.operators import clusters, investigate, metrics, records, report, similar, triage
from trivet.plans import benchmark, dataset
from trivet.queries import _HARMLESS, _LIKELY, _ONLY_BENCH, CLS, DET, ENT, REC, _answers, bench, _r, _records, _table, detections, query
from trivet.sources import daily, readers, writers


def _folder(spark: SparkSession) -> str:
    return f"{clusters.shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, write: Callable[[str], None]) -> str:
    path = _folder(spark)
    write(path)
    return path


def _tuples(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).select("context", F.col("owner").alias("username"), F.when(F.col("doc_id") % 9 != 0, F.col("matched_value")).alias("password"))


_TUP = f"{DET}, tup AS (SELECT doc_id, context, owner AS username, CASE WHEN doc_id % 9 <> 0 THEN matched_value END AS password FROM det)"
_H = "sha256(context) AS context_hash"


@query(f"WITH {_TUP} SELECT {_H}, username, password FROM tup")
def source_tuple_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, lambda p: writers.write_tuples(_tuples(spark, sf), p))
    return readers.read_tuples(spark, path, fallback=False).select(F.sha2("context", 256).alias("context_hash"), "username", "password")


@query(f"""WITH {_TUP} SELECT 'doc ' || doc_id AS context, '"u' || doc_id || '"' AS username, coalesce('''' || doc_id || '''', 'None') AS password FROM tup""")
def source_tuple_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are no literal: the pattern's groups as they stand."""
    q = F.lit('"""')
    i = F.col("doc_id").cast("string")
    line = F.concat(F.lit("no python ( "), q, F.lit("doc "), i, q, F.lit(', "u'), i, F.lit("\", '"), i, F.lit("' ) ="))
    path = _written(spark, lambda p: _table(spark, sf, "documents").select(line).write.text(p))
    return readers.read_tuples(spark, path).select("context", "username", "password")


@query(
    rf"""WITH {_TUP}, c AS (SELECT substr(regexp_replace(context, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g'), 1, 600) AS context, nullif(username, '') AS username, regexp_replace(password, ',+$', '') AS password FROM tup)
  SELECT sha256(context) AS context_hash, username, password, 'REAL' AS status, 1::INT AS is_credentials FROM c WHERE password IS NOT NULL AND password NOT IN ('', 'None', 'null', 'NULL')"""
)
def labelled_files(spark: SparkSession, sf: str) -> DataFrame:
    """REAL rows without a password go."""
    path = _written(spark, lambda p: writers.write_tuples(_tuples(spark, sf), p))
    rows = records.make_records(readers.read_tuples(spark, path), "REAL")
    return rows.select(F.sha2("context", 256).alias("context_hash"), "username", "password", "status", "is_credentials")


_DETECTION = "file_path, owner, source, pattern_name, matched_value, match_line_number, sha256(context) AS context_hash"


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context_hash", F.sha2("context", 256)).drop("context", "doc_id")


@query(f"WITH {DET} SELECT {_DETECTION} FROM det")
def source_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, lambda p: writers.write_json_lines(detections(spark, sf).drop("doc_id"), p))
    return _named(readers.read_json_lines(spark, path, schema.DETECTION))


@query(f"WITH {DET} SELECT {_DETECTION} FROM det")
def source_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, lambda p: writers.write_json_array(detections(spark, sf).drop("doc_id"), p))
    return _named(readers.read_detections(spark, path))


@query("""SELECT id::VARCHAR AS record_id, 'quality ' || quality || ' of ' || doc_id AS reasoning, toxic::INT AS evidence FROM (SELECT *, doc_id % 97 AS id, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id DESC) AS r FROM labels) WHERE r = 1""")
def source_rationales(spark: SparkSession, sf: str) -> DataFrame:
    """The last rationale of each record, in the order of files and lines."""
    why = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" of "), F.col("doc_id").cast("string"))
    what = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    rows = _table(spark, sf, "labels").orderBy("doc_id").select((F.col("doc_id") % 97).cast("string").alias("record_id"), why.alias("reasoning"), what.alias("evidence"))
    path = _written(spark, lambda p: writers.write_json_lines(rows, p))
    return readers.read_rationales(spark, path).select("record_id", "reasoning", F.size("evidence").alias("evidence"))


@query("SELECT doc_id::VARCHAR AS record_id, count(*) AS written FROM documents GROUP BY 1")
def append_and_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the records, broken lines, then all that are missing: each record is written once."""
    rows = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "source")
    path = _folder(spark)
    writers.append_missing(rows.filter("record_id % 3 = 0"), None, path)
    spark.range(5).select(F.concat(F.lit('{"record_id": '), F.col("id").cast("string"), F.lit(', "broken'))).coalesce(1).write.mode("append").text(path)
    writers.append_missing(rows, readers.read_done_ids(spark, path), path)
    return readers.read_json_lines(spark, path, "record_id string, source string").groupBy("record_id").agg(F.count(F.lit(1)).alias("written"))


@query(f"WITH {REC} SELECT record_id, password FROM (SELECT record_id, replace(substr(coalesce(password, 'None'), 1, 40), chr(10), ' ') AS password FROM rec ORDER BY record_id LIMIT 500)")
def head_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, lambda p: writers.write_inspection(_records(spark, sf), p, head=500))
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("record_id", "password")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return records.prompt_pairs(_records(spark, sf))


_PAIRS = f"""{REC}, pairs AS (SELECT record_id, 'File: synthetic/training_sample | Source: documents' || chr(10) || 'Pattern: PASSWORD | Match: ' || coalesce(password, 'None') || chr(10) || 'Context:' || chr(10)
  || CASE WHEN username IS NOT NULL AND NOT contains(context, 'username=' || username) THEN 'username=' || username || chr(10) ELSE '' END || context AS prompt,
  username, password FROM rec)"""
#: A completion's text, by its parts.
_COMPLETION = f"""'{{"is_credentials":0,"status":"FALSE_POSITIVE","confidence":0.95,"reasoning":"Labelled as a false positive by its source.","evidence":["source:documents"' || CASE WHEN username IS NOT NULL THEN ',"near username"' ELSE '' END
  || CASE WHEN {ENT.format("password")} >= 3.5 THEN ',"high entropy"' ELSE '' END || '],"agent_trace":{{"strategy":"supervised_label","checks":["source_label","features","context"],"tool_calls":[]}}}}'"""


@query(f"WITH {_PAIRS} SELECT sha256(prompt) AS prompt_hash, {_COMPLETION} AS completion FROM pairs")
def prompt_completion_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of written pairs; only they are read."""
    path = _written(spark, lambda p: writers.write_json_lines(_pairs(spark, sf), p))
    return readers.read_json_lines(spark, path, "prompt string, completion string").select(F.sha2("prompt", 256).alias("prompt_hash"), "completion")


@query(f"WITH {_PAIRS} SELECT 'decide' AS instruction, sha256(prompt) AS input_hash, {_COMPLETION} AS output FROM pairs")
def instruction_array(spark: SparkSession, sf: str) -> DataFrame:
    path = _written(spark, lambda p: writers.write_json_array(writers.instruction_rows(_pairs(spark, sf), "decide"), p))
    rows = spark.read.schema("instruction string, input string, output string").json(path, multiLine=True)
    return rows.select("instruction", F.sha2("input", 256).alias("input_hash"), "output")


@query(f"WITH {REC} SELECT record_id, context AS text, username, password, 'FALSE_POSITIVE' AS label FROM rec")
def labelled_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).select("record_id", F.col("context").alias("text"), "username", "password", F.col("status").alias("label"))
    path = _written(spark, lambda p: writers.write_json_lines(rows, p))
    return readers.read_json_lines(spark, path, "record_id string, text string, username string, password string, label string")


@query(f"""WITH {REC}, c AS (SELECT 'status' AS counter, 'FALSE_POSITIVE' AS value, count(*) AS n FROM rec UNION ALL SELECT 'is_credentials', '0', count(*) FROM rec UNION ALL SELECT 'distractor_type', 'original', count(*) FROM rec) SELECT * FROM c""")
def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(name, value, n) for name, counts in dataset.merge_report(_records(spark, sf)).items() for value, n in counts.items()]
    return spark.createDataFrame(rows, "counter string, value string, n long")


@query(f"""WITH {DET}{CLS}, i AS (SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, pattern_name, match_line_number, status, confidence, substr(sha256(matched_value), 1, 16) AS value_hash FROM dec),
  s AS (SELECT owner, count(*) AS total FROM i GROUP BY 1)
  SELECT owner, pattern_name AS file, match_line_number AS line, status, value_hash, total FROM i JOIN s USING (owner)""")
def nested_owner_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nested report in parts, item by item, and each owner's summary."""
    decided = clusters.written(triage.flat(triage.classify(detections(spark, sf))).withColumn("file_path", F.col("pattern_name")).drop("context"))
    nested = clusters.written(report.nested_report(decided, most=100))
    items = nested.select("owner", F.explode("files").alias("file", "items")).select("owner", "file", F.explode("items").alias("x"))
    total = nested.filter("part = 0").select("owner", "summary.total")
    return items.select("owner", "file", F.col("x.match_line_number").alias("line"), "x.status", "x.value_hash").join(total, "owner")


@query(f"WITH {REC} SELECT record_id, 'synthetic/training_sample' AS file_path, 'unknown' AS owner, 'documents' AS source, 'PASSWORD' AS pattern_name, coalesce(password, 'None') AS matched_value, h AS context_hash FROM rec")
def runner_detections(spark: SparkSession, sf: str) -> DataFrame:
    rows = benchmark.as_detections(_records(spark, sf))
    return rows.select("record_id", "file_path", "owner", "source", "pattern_name", "matched_value", T.context_hash(F.col("context")).alias("context_hash"))


_TEACHER = benchmark.TEACHER.replace("'", "''")


@query(f"""WITH {_PAIRS} SELECT record_id, sha256(prompt || chr(10) || chr(10) || 'Label:' || chr(10) || '{{"is_credentials":0,"status":"FALSE_POSITIVE"}}' || chr(10) || chr(10) || '{_TEACHER}') AS prompt_hash FROM pairs""")
def teacher_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.teacher_prompts(_pairs(spark, sf)).select("record_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(f"""WITH {_PAIRS}
  SELECT record_id, 'because ' || length(prompt) AS reasoning, 5::INT AS evidence, 't' AS teacher FROM pairs WHERE record_id NOT LIKE '%7' AND length(prompt) % 5 <> 0""")
def distilled(spark: SparkSession, sf: str) -> DataFrame:
    """Usable answers only, of records that are not done; evidence has five items at most."""

    def teacher(df: DataFrame, model: str, temperature: float) -> DataFrame:
        base = F.regexp_extract("prompt", r"(?s)^(.*)\n\nLabel:\n", 1)
        items = ", ".join(f'"{i}"' for i in range(7))
        good = F.concat(F.lit('So: {"reasoning": " because '), F.length(base).cast("string"), F.lit(f' ", "evidence": [{items}]}}'))
        return df.withColumn("raw_response", F.when(F.length(base) % 5 == 0, F.lit('{"reasoning": " "}')).otherwise(good))

    pairs = _pairs(spark, sf)
    done = pairs.filter("record_id LIKE '%7'").select("record_id")
    return benchmark.distill(pairs, teacher, "t", done).select("record_id", "reasoning", F.size("evidence").alias("evidence"), "teacher")


@query("SELECT 25::BIGINT AS usable")
def distill_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The limit counts usable answers, not calls."""
    pairs = _pairs(spark, sf)
    teacher = lambda df, model, temperature: df.withColumn("raw_response", F.when(F.crc32("record_id") % 3 == 0, F.lit('{"reasoning": "so"}')))
    return benchmark.distill(pairs, teacher, "t", limit=25).agg(F.count(F.lit(1)).alias("usable"))


@query(f"""WITH a AS (SELECT event_id, value, (event_id % 6)::INT + 1 AS k FROM events)
  SELECT event_id::VARCHAR AS record_id, CASE WHEN event_id % 2 = 0 THEN 'REAL' ELSE 'REVIEW' END AS expected_status, list_extract(['REAL', 'REVIEW', 'REVIEW', 'REVIEW', 'REVIEW', 'REVIEW'], k) AS predicted_status,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::INT AS expected_binary, list_extract([1, 0, 1, 0, 0, 0], k)::INT AS predicted_binary, k NOT IN (4, 5) AS json_valid, k = 1 AND value BETWEEN 0 AND 1 AS schema_valid FROM a""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers against the labels that completions hold."""
    even = F.col("event_id") % 2 == 0
    completion = F.when(even, F.lit('text {"status": "REAL", "is_credentials": 1}')).otherwise(F.lit('{"status": "REVIEW"}'))
    rows = _answers(spark, sf).select(F.col("event_id").cast("string").alias("record_id"), completion.alias("completion"), F.col("answer").alias("raw_response"))
    return benchmark.evaluate(rows).drop("completion", "raw_response")


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'r' END AS reasoning, CASE WHEN event_id % 6 = 0 THEN 2 END::INT AS evidence FROM events""")
def rationales_of_answers(spark: SparkSession, sf: str) -> DataFrame:
    r = _answers(spark, sf).withColumn("r", jsonx.rationale(jsonx.json_object(F.col("answer"))))
    return r.select("event_id", "r.reasoning", F.when(F.col("r").isNotNull(), F.size("r.evidence")).alias("evidence"))


_OPEN = """'x {"status": "REAL", "reasoning": "a } b { ' || event_id || '"} y {"status": "REVIEW"}'"""


@query("""SELECT event_id, 'REAL' AS status, 'a } b { ' || event_id AS reasoning FROM events""")
def braces_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "events").select("event_id", F.expr(_OPEN.replace("event_id", "cast(event_id AS string)")).alias("t"))
    raw = jsonx.raw_fields(jsonx.json_object(F.col("t")))
    return rows.select("event_id", raw.alias("r")).select("event_id", "r.status", "r.reasoning")


_LOW = "lower(coalesce(matched_value, ''))"


@query(
    f"""WITH {DET} SELECT doc_id, list_aggregate(list_filter({list(tools.PLACEHOLDER_TERMS)}, lambda t: contains({_LOW}, t)), 'count') > 0 AS is_placeholder, round({ENT.format("matched_value")}, 6) AS entropy,
  CASE {" ".join(f"WHEN regexp_matches(lower(file_path), '{'|'.join(t.replace('.', chr(92) + '.') for t in terms)}') THEN '{k}'" for k, terms in tools.PATH_CLASSES.items())} ELSE 'source' END AS path_class, 4::INT AS checks FROM det"""
)
def basic_tools(spark: SparkSession, sf: str) -> DataFrame:
    """The four checks as one JSON text, read back."""
    out = detections(spark, sf).select("doc_id", tools.basic_tools(F.col("matched_value"), F.col("context"), F.col("file_path")).alias("t"))
    got = lambda p: F.get_json_object("t", p)
    return out.select("doc_id", got("$[1].is_placeholder").cast("boolean").alias("is_placeholder"), _r(got("$[0].features.entropy").cast("double")).alias("entropy"), got("$[3].path_class").alias("path_class"), F.json_array_length("t").alias("checks"))


@query(f"""WITH {_PAIRS}, t AS (SELECT record_id, list_transform(string_split(prompt, ' '), lambda w: length(w)) AS p, list_transform(string_split({_COMPLETION}, ' '), lambda w: length(w)) AS c FROM pairs),
  u AS (SELECT *, p || c AS a FROM t)
  SELECT record_id, list_transform(range(1, 65), lambda i: coalesce(a[i], 0))::INT[] AS input_ids, list_transform(range(1, 65), lambda i: CASE WHEN i <= len(a) THEN 1 ELSE 0 END)::INT[] AS attention_mask,
  list_transform(range(1, 65), lambda i: CASE WHEN i > len(p) AND i <= len(a) THEN a[i] ELSE -100 END)::INT[] AS labels FROM u""")
def training_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, mask and labels, cut and padded; word lengths stand for ids."""
    return benchmark.training_arrays(_pairs(spark, sf), _word_lengths, length=64)


def _word_lengths(text: str) -> list[int]:
    return [len(w) for w in text.removesuffix("\n").split(" ")]


@query(f"""WITH {REC}, run AS (SELECT 'synthetic/training_sample' AS file_path, 'documents' AS source, 'PASSWORD' AS pattern_name, coalesce(password, 'None') AS matched_value, context FROM rec), s AS (SELECT NOT ({_HARMLESS}) AND ({_LIKELY}) AS hit FROM run)
  SELECT 'native' AS model, count(*) + 7 AS total, (count_if(NOT hit) + 6)::BIGINT AS correct, round((count_if(NOT hit) + 6) / (count(*) + 7), 6) AS accuracy, count(*) + 7 AS schema_ok, 1.0::DOUBLE AS schema_validity FROM s""")
def smoke(spark: SparkSession, sf: str) -> DataFrame:
    """The seven cases whose answers are known, among the records of all documents; the rule responder does not know one
    issued format."""
    cases = benchmark.smoke_cases(spark).unionByName(_records(spark, sf), allowMissingColumns=True)
    rows = benchmark.bench_rows(cases, {"native": triage.native_provider}, ("direct_json",))
    return benchmark.smoke_summary(rows).withColumn("accuracy", _r("accuracy"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-14 12:00:00' - INTERVAL 30 DAYS OR ts IS NULL")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a table of days: whole days go, of the border day what is older, later files stay as they are."""
    path = _folder(spark)
    rows = _table(spark, sf, "events").select("event_id", "ts")
    daily.write_daily(rows, "ts", path)
    daily.expire_daily(spark, path, "ts", dt.datetime(2024, 2, 14, 12))
    return spark.read.schema(rows.schema).parquet(path).select("event_id", "ts")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL 30 DAYS")
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    return records.expire(_table(spark, sf, "orders"), "o_orderdate", F.lit("1998-01-01").cast("date")).select("o_orderkey")


@query(f"""WITH {DET}{CLS} SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, file_path, round_even(confidence, 2)::DOUBLE AS confidence, substr(sha256(matched_value), 1, 16) AS value_hash FROM dec""")
def report_items(spark: SparkSession, sf: str) -> DataFrame:
    items = report.report_items(triage.flat(triage.classify(detections(spark, sf))))
    return items.select("owner", "file_path", "confidence", "value_hash")


@query("SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'react' WHEN 2 THEN 'analyst' ELSE 'self_consistency' END AS route FROM events) GROUP BY 1")
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = _table(spark, sf, "events").select(F.when(k == 0, "accept").when(k == 1, "react").when(k == 2, "analyst").otherwise("self_consistency").alias("route"))
    return metrics.escalation(rows).withColumn("share", _r("share"))


@query(f"""WITH {DET} SELECT doc_id, round({ENT.format("matched_value")}, 6) AS entropy, substr(sha256(matched_value), 1, 16) AS value_hash, len(list_filter({list(tools.PLACEHOLDER_TERMS)}, lambda t: contains({_LOW}, t)))::INT AS placeholders,
  CASE {" ".join(f"WHEN regexp_matches(lower(file_path), '{'|'.join(t.replace('.', chr(92) + '.') for t in terms)}') THEN '{k}'" for k, terms in tools.PATH_CLASSES.items())} ELSE 'source' END AS path_class,
  CASE {" ".join(f"WHEN regexp_matches(matched_value, '{p}') THEN '{k}'" for k, p in tools.SECRET_SHAPES.items())} END AS shape FROM det""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The tools as functions of SQL."""
    tools.register_sql(spark)
    exprs = ["doc_id", "value_entropy(matched_value) AS entropy", "value_hash(matched_value) AS value_hash", "size(placeholder_terms(matched_value)) AS placeholders", "path_class(file_path) AS path_class", "secret_shape(matched_value) AS shape"]
    return detections(spark, sf).selectExpr(*exprs).withColumn("entropy", _r("entropy"))


_BENCH_TEXT = "CASE WHEN event_id % 5 = 0 THEN 'please Ignore previous orders' WHEN event_id % 7 = 0 THEN 'act as an auditor' ELSE 'plain text' END"


@query(f"""{_ONLY_BENCH}, i AS (SELECT model, strategy, expected_status = predicted_status AS ok, record_id::BIGINT % 5 = 0 OR record_id::BIGINT % 7 = 0 AS hit FROM bench)
  SELECT model, strategy, count_if(hit) AS injected, round(avg(ok::INT) FILTER (hit), 6) AS resistance, round(avg(ok::INT) FILTER (NOT hit), 6) AS others FROM i GROUP BY 1, 2""")
def injection_resistance(spark: SparkSession, sf: str) -> DataFrame:
    rows = bench(spark, sf).withColumn("context", F.expr(_BENCH_TEXT.replace("event_id", "cast(record_id AS bigint)")))
    return metrics.injection_resistance(rows).withColumns({c: _r(c) for c in ("resistance", "others")})


@query(f"""{_ONLY_BENCH} SELECT record_id, string_agg(DISTINCT predicted_status, ',' ORDER BY predicted_status) AS statuses, count(DISTINCT predicted_status) > 1 AS disagree
  FROM (SELECT (record_id::BIGINT // 3)::VARCHAR AS record_id, predicted_status FROM bench) GROUP BY 1""")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    rows = bench(spark, sf).withColumn("record_id", F.floor(F.col("record_id").cast("long") / 3).cast("string"))
    return metrics.disagreements(rows).withColumn("statuses", F.array_join("statuses", ","))


@query("""SELECT 'm' AS model, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS strategy, round(avg((event_id % 6 = 1)::INT), 6) AS repaired_rate, round(avg((event_id % 6 IN (3, 4))::INT), 6) AS fallback_rate, 2.0::DOUBLE AS prompt_words FROM events GROUP BY 2""")
def answer_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).select(F.lit("m").alias("model"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("strategy"), F.lit(" two  words\n").alias("prompt"), F.col("answer").alias("raw_response"))
    return metrics.answer_rates(rows).select("model", "strategy", _r("repaired_rate").alias("repaired_rate"), _r("fallback_rate").alias("fallback_rate"), "prompt_words")


@query("SELECT event_type, le, count_if(value <= le) AS n FROM events, (SELECT unnest([1.0, 10.0, 50.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(_table(spark, sf, "events"), "value", (1, 10, 50), "event_type")


@query(f"""WITH {DET}{CLS}, o AS (SELECT doc_id, pattern_name, confidence FROM dec WHERE status = 'REVIEW') SELECT doc_id, round(count(*) OVER (PARTITION BY pattern_name) + 1 - abs(confidence - 0.5) * 2, 6)::DOUBLE AS priority FROM o""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    decided = triage.flat(triage.classify(detections(spark, sf)))
    return metrics.review_queue(decided, "pattern_name").select("doc_id", _r("priority").alias("priority"))


@query("""SELECT value, count(*) AS n FROM (SELECT CASE WHEN n < 8 THEN '<8' WHEN n < 16 THEN '8-15' WHEN n < 32 THEN '16-31' WHEN n < 64 THEN '32-63' ELSE '>=64' END AS value FROM (SELECT length(p_name) AS n FROM part)) GROUP BY 1""")
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "part").select(metrics.length_bucket(F.length("p_name")).alias("bucket"))
    return metrics.value_counts(rows, "bucket").withColumnRenamed("count", "n")


_RESAMPLE = "(('0x' || substr(md5('42|resample|' || o_orderkey), 1, 15))::BIGINT % 1000000)"


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, 3000 / (count(*) OVER (PARTITION BY o_orderstatus))::DOUBLE AS rate FROM orders),
  c AS (SELECT *, floor(rate)::INT + CASE WHEN {_RESAMPLE} < (rate - floor(rate)) * 1000000 THEN 1 ELSE 0 END AS copies FROM r) SELECT o_orderkey, o_orderstatus, copies::BIGINT AS copies FROM c WHERE copies > 0""")
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.resampled(_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 3000, "o_orderstatus", "o_orderkey")
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.count("copy").alias("copies"))


@query("""SELECT count(*) AS rows, sum(('0x' || substr(sha256('{"c_custkey":' || c_custkey || '}'), 1, 12))::BIGINT)::VARCHAR AS content_digest, 7::INT AS seed, 'test' AS purpose FROM customer""")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    out = records.provenance(_table(spark, sf, "customer").select("c_custkey"), 7, (triage.SYSTEM,), purpose="test")
    return out.select("rows", "content_digest", "seed", "purpose")


@query(f"""WITH {REC}, l AS (SELECT unnest([200, 300, 600]) AS context_chars), run AS (SELECT context_chars, 'synthetic/training_sample' AS file_path, 'documents' AS source, 'PASSWORD' AS pattern_name, coalesce(password, 'None') AS matched_value, substr(context, 1, context_chars) AS context FROM rec, l)
  SELECT context_chars::INT AS context_chars, CASE WHEN {_HARMLESS} THEN 'FALSE_POSITIVE' WHEN {_LIKELY} THEN 'REAL' ELSE 'REVIEW' END AS predicted_status, count(*) AS n FROM run GROUP BY 1, 2""")
def context_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows = benchmark.context_ablation(_records(spark, sf), triage.native_provider, "native")
    return rows.groupBy("context_chars", "predicted_status").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4))"


@query(f"""WITH p AS (SELECT doc_id::VARCHAR AS example_id, {_WORDS.format("text")} AS es FROM documents WHERE doc_id < 40), d AS (SELECT doc_id AS id, {_WORDS.format("text")} AS ws FROM documents),
  s AS (SELECT id, example_id, len(list_intersect(ws, es)) AS c, len(ws) AS n, len(es) AS m FROM d, p), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c / (n + m - c) DESC, example_id) AS k FROM s WHERE c > 0)
  SELECT d.id, coalesce(string_agg(example_id, ',' ORDER BY k), '') AS examples FROM d LEFT JOIN t ON d.id = t.id AND k <= 2 GROUP BY d.id""")
def similar_examples(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    pool = docs.filter("doc_id < 40").select(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("context"))
    out = triage.similar_examples(docs.withColumnRenamed("text", "context"), pool, "doc_id")
    return out.select("id", F.array_join(F.transform("examples", lambda x: x["example_id"]), ",").alias("examples"))


_CALL_STATUS = "list_extract(['REAL', 'FALSE_POSITIVE', 'REVIEW'], (event_id % 3)::INT + 1)"


@query(f"""WITH x AS (SELECT event_id, user_id, date_trunc('hour', ts) AS h, event_type = 'click' AS is_call, 't' || (event_id % 4) AS tool, value, CASE WHEN event_type <> 'click' THEN {_CALL_STATUS} END AS status FROM events),
  y AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY h, is_call, event_id ROWS UNBOUNDED PRECEDING) AS b,
    first_value(status IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY h, is_call, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM x)
  SELECT tool, count(*) AS calls, round(avg(value), 6) AS avg_latency_ms, round(avg((a <> b)::INT), 6) AS changed_rate, round(avg((a <> 'REVIEW')::INT) FILTER (b = 'REVIEW'), 6) AS review_resolved_rate FROM y WHERE is_call GROUP BY 1""")
def tool_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Calls among the decisions of their user; many times tie, and first calls have no decision before them."""
    e = F.col("event_id")
    rows = _table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("at"), "event_id", "event_type", F.col("value").alias("latency_ms"))
    calls = rows.filter("event_type = 'click'").select("user_id", "at", "event_id", "latency_ms", F.concat(F.lit("t"), (e % 4).cast("string")).alias("tool"))
    status = F.get(F.array(*map(F.lit, ("REAL", "FALSE_POSITIVE", "REVIEW"))), (e % 3).cast("int"))
    decisions = rows.filter("event_type <> 'click'").select("user_id", "at", "event_id", status.alias("status"))
    out = metrics.tool_effects(metrics.asof_decisions(calls, decisions, "user_id", "at", "event_id"))
    return out.select("tool", "calls", *[_r(c).alias(c) for c in ("avg_latency_ms", "changed_rate", "review_resolved_rate")])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS id, p.vec_id AS example_id, list_cosine_similarity(q.e, p.e) AS score FROM v q JOIN v p ON q.vec_id % 10 = 3 AND p.vec_id % 10 <> 3)
  SELECT id, k AS rank, example_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, example_id) AS k FROM s) WHERE k <= 4""")
def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of a pool by cosine, for a stated set of queries."""
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pool = rows.filter("id % 10 <> 3").withColumnRenamed("id", "example_id")
    out = similar.most_similar(rows.filter("id % 10 = 3"), pool, 4)
    return out.select("id", F.posexplode("examples").alias("rank", "x")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), "x.example_id", _r("x.score").alias("score"))


_SIGNS = {h: [f"contains(g, '{w}')::INT" for w in words] for h, words in investigate.SIGNS.items()}


@query(f"""WITH {DET}, g AS (SELECT doc_id, lower(context || ' ' || coalesce(matched_value, '') || ' ' || file_path) AS g FROM det),
  h AS (SELECT doc_id, {{'h': h.h, 'i': h.i}} AS x, CASE h.h {" ".join(f"WHEN '{h}' THEN ({' + '.join(s)}) / 3.0" for h, s in _SIGNS.items())} END AS score FROM g, (SELECT unnest({list(_SIGNS)}) AS h, unnest(range({len(_SIGNS)})) AS i) h),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, x.i) AS k FROM h)
  SELECT a.doc_id, a.x.h AS hypothesis, b.x.h AS second, round((a.score + b.score) / 2, 6) AS score, CASE a.x.h WHEN 'REAL' THEN 'REAL' WHEN 'ROTATED' THEN 'REVIEW' ELSE 'FALSE_POSITIVE' END AS status
  FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2""")
def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of a beam search; equal paths in another order tie, and the better first hypothesis by order leads."""
    out = investigate.investigate(detections(spark, sf), "doc_id")
    return out.select("doc_id", "hypothesis", F.col("path")[1]["hypothesis"].alias("second"), _r("score").alias("score"), "status")


PIECES = tuple("the and ing ion ent tion die der und ch sch en er que les ou éc el la os de in on an re st th he ha ver keit un ie ei ll es".split()) + (" the", " und", ". ", ", ", "  ")
_BY_LENGTH = "|".join(p.replace(".", "[.]") for p in sorted(PIECES, key=lambda p: -len(p)))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?s){_BY_LENGTH}|.')) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy longest matches of a vocabulary in whole texts."""
    return _table(spark, sf, "documents").select("doc_id", tokens.counter(spark, PIECES)(F.col("text")).alias("n_tokens"))


@query("SELECT o_orderpriority || ':' || o_orderstatus AS value, count(*) AS n, 1::BIGINT AS calls FROM orders GROUP BY 1")
def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Few distinct prompts of very many rows: each is asked once (every answer names its call)."""
    fixed = {c: F.lit(c) for c in ("file_path", "source", "pattern_name", "context")}
    rows = _table(spark, sf, "orders").select(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("matched_value")).withColumns(fixed)
    asked = triage.ask(rows, triage.callable_provider(lambda *_: f'{{"status": "REVIEW", "reasoning": "{uuid.uuid4()}"}}'))
    return asked.groupBy(F.col("matched_value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("decision.reasoning").alias("calls"))

"""Queries of the triage library over the test tables, and their SQL.

``documents`` serve as detections (the text is the context), ``events`` as benchmark rows, ``orders`` and ``customer`` as
records with classes and groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.functions import jsonx, tools
from trivet.functions import text as T
from trivet.operators import augment, clusters, metrics, records, report, synth, triage
from trivet.plans import benchmark
from trivet.sources import writers
from trivet.streaming import triage as streams


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """A detection for each document: its first assigned token, else its first address, else its first word."""
    x = F.coalesce("text", F.lit(""))
    first = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))

    def found(name: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(name).alias("name"), v.alias("value"), v.isNotNull().alias("ok"))

    of = lambda name, p, rest: T.let(T.let(first(p), found(name)), lambda f: F.when(f["ok"], f).otherwise(rest))
    mail = T.let(F.when(F.contains(x, F.lit("@")), first(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)")), found("EMAIL"))  # tried where it can be
    match = of("TOKEN", r'token = "([0-9a-f]+)"', T.let(mail, lambda f: F.when(f["ok"], f).otherwise(T.let(first(r"([^\x00-\x20]+)"), found("WORD")))))
    folder = F.get(F.array(*map(F.lit, ("src", "docs", "tests", "config"))), (F.col("doc_id") % 4).cast("int"))
    return _table(spark, sf, "documents").withColumn("match", match).select(
        "doc_id",
        F.concat(folder, F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("owner"),
        F.lit("scanner").alias("source"),
        F.col("match.name").alias("pattern_name"),
        F.col("match.value").alias("matched_value"),
        F.col("doc_id").cast("int").alias("match_line_number"),
        x.alias("context"),
    )


DET = r"""
det AS (SELECT doc_id, list_extract(['src', 'docs', 'tests', 'config'], (doc_id % 4)::INT + 1) || '/' || coalesce(source, '') || '/' || doc_id || '.txt' AS file_path,
  CASE WHEN doc_id % 11 <> 0 THEN source END AS owner, 'scanner' AS source,
  CASE WHEN token IS NOT NULL THEN 'TOKEN' WHEN mail IS NOT NULL THEN 'EMAIL' ELSE 'WORD' END AS pattern_name,
  coalesce(token, mail, nullif(regexp_extract(x, '([^\x00-\x20]+)', 1), '')) AS matched_value, doc_id::INT AS match_line_number, x AS context
  FROM (SELECT *, coalesce(text, '') AS x, nullif(regexp_extract(coalesce(text, ''), 'token = "([0-9a-f]+)"', 1), '') AS token,
        nullif(regexp_extract(coalesce(text, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1), '') AS mail FROM documents))"""
ENT = "CASE WHEN length({0}) > 0 THEN list_aggregate(string_split({0}, ''), 'entropy') ELSE 0.0 END"
PROMPT = "'File: ' || file_path || ' | Source: ' || source || chr(10) || 'Pattern: ' || pattern_name || ' | Match: ' || coalesce(matched_value, 'None') || chr(10) || 'Context:' || chr(10) || context"
_HARMLESS = "regexp_matches(lower(coalesce(matched_value, 'None')), '" + "|".join(triage.RESPONDER_PLACEHOLDERS) + f"') OR regexp_matches(lower({PROMPT}), '" + "|".join(triage.RESPONDER_RESETS) + "')"
_V = "coalesce(matched_value, '')"
_LIKELY = f"(length({_V}) > 20 AND regexp_matches({_V}, '[!@#$%^&*]')) OR contains(lower({PROMPT}), 'bearer ') OR starts_with({_V}, 'AKIA') OR (length({_V}) - length(replace({_V}, '-', '')) >= 4 AND length({_V}) > 30)"
CLS = f""",
cls AS (SELECT *, {ENT.format("matched_value")} AS ent, {_HARMLESS} AS harmless, {_LIKELY} AS likely FROM det),
dec AS (SELECT *, ent < 2.5 AS low, CASE WHEN ent < 2.5 OR harmless THEN 'FALSE_POSITIVE' WHEN likely THEN 'REAL' ELSE 'REVIEW' END AS status,
  CASE WHEN ent < 2.5 THEN 0.95 WHEN harmless THEN 0.9 WHEN likely THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence,
  (NOT ent < 2.5 AND NOT harmless AND likely)::INT AS is_credentials FROM cls)"""


def bench(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows from events."""
    e = F.col("event_id")
    at = lambda options, n: F.get(F.array(*map(F.lit, options)), (n % len(options)).cast("int"))
    statuses = ("REAL", "FALSE_POSITIVE", "REVIEW")
    rows = _table(spark, sf, "events").select(
        e.cast("string").alias("record_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        at(("direct_json", "few_shot", "self_consistency", "react_triage"), F.floor(e / 3)).alias("strategy"),
        at(statuses, e * 7 + F.floor(e / 5)).alias("expected_status"),
        at(statuses, F.when(e % 4 == 0, e).otherwise(e * 7 + F.floor(e / 5))).alias("predicted_status"),
        ((e % 101) / 100).alias("confidence"),
        (e % 17 != 0).alias("json_valid"),
        (e % 13 != 0).alias("schema_valid"),
        ((e % 9) / 8).alias("evidence_grounding"),
        F.col("value").alias("latency_ms"),
        at((None, "none_literal", "hard_negative", "context_token", ""), F.floor(e / 7)).alias("distractor_type"),
    )
    flag = lambda c: (F.col(c) == "REAL").cast("int")
    rows = rows.withColumn("expected_is_credentials", flag("expected_status")).withColumn("predicted_is_credentials", flag("predicted_status"))
    return rows.withColumn("escalated", F.when(F.col("strategy") == "self_consistency", F.col("confidence").between(0.4, 0.6)))


BENCH = """
bench AS (SELECT *, (expected_status = 'REAL')::INT AS expected_is_credentials, (predicted_status = 'REAL')::INT AS predicted_is_credentials,
  CASE WHEN strategy = 'self_consistency' THEN confidence BETWEEN 0.4 AND 0.6 END AS escalated FROM (
  SELECT event_id::VARCHAR AS record_id, 'm' || (user_id % 3) AS model,
  list_extract(['direct_json', 'few_shot', 'self_consistency', 'react_triage'], ((event_id // 3) % 4)::INT + 1) AS strategy,
  list_extract(['REAL', 'FALSE_POSITIVE', 'REVIEW'], ((event_id * 7 + event_id // 5) % 3)::INT + 1) AS expected_status,
  list_extract(['REAL', 'FALSE_POSITIVE', 'REVIEW'], ((CASE WHEN event_id % 4 = 0 THEN event_id ELSE event_id * 7 + event_id // 5 END) % 3)::INT + 1) AS predicted_status,
  (event_id % 101) / 100.0::DOUBLE AS confidence, event_id % 17 <> 0 AS json_valid, event_id % 13 <> 0 AS schema_valid, (event_id % 9) / 8.0::DOUBLE AS evidence_grounding,
  value AS latency_ms, list_extract([NULL, 'none_literal', 'hard_negative', 'context_token', ''], ((event_id // 7) % 5)::INT + 1) AS distractor_type FROM events)),
agg AS (SELECT {by} count_if(t = 1 AND p = 1) AS tp, count_if(t = 0 AND p = 0) AS tn, count_if(t = 0 AND p = 1) AS fp, count_if(t = 1 AND p = 0) AS fn, count(*) AS n
  FROM (SELECT *, expected_is_credentials AS t, predicted_is_credentials AS p, coalesce(nullif(distractor_type, ''), 'original') AS slice FROM bench){src} GROUP BY {group}),
sc AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-300) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM agg))"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query(f"""WITH {DET} SELECT doc_id, round({ENT.format("matched_value")}, 6) AS entropy, coalesce(length(matched_value), 0)::INT AS length,
  regexp_matches({_V}, '[^\\p{{L}}\\p{{N}}]') AS has_special, regexp_matches({_V}, '\\p{{Lu}}') AS has_upper, regexp_matches({_V}, '\\p{{Ll}}') AS has_lower, regexp_matches({_V}, '[\\p{{Nd}}²³¹]') AS has_digit FROM det""")
def features(spark: SparkSession, sf: str) -> DataFrame:
    f = T.features(F.col("matched_value"))
    rows = detections(spark, sf).select("doc_id", f.alias("f")).select("doc_id", "f.*")
    return rows.withColumn("entropy", _r("entropy"))


def _word(p: str) -> str:
    return p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}\p{M}_])(", 1).replace(r")\b", r")(?:$|[^\p{L}\p{N}\p{M}_])", 1).replace(r"\b(?:INC|RITM|CHG)\d+\b", r"(?:^|[^\p{L}\p{N}\p{M}_])(?:INC|RITM|CHG)\p{Nd}+(?:$|[^\p{L}\p{N}\p{M}_])")


@query(
    f"WITH {DET} SELECT doc_id, {', '.join(f'''regexp_matches(context, '(?i){_word(p)}') AS {k}''' for k, p in tools.CONTEXT_SIGNALS.items())}, "
    f"list_aggregate(list_filter({list(tools.PLACEHOLDER_TERMS)}, lambda t: contains(lower({_V}), t)), 'string_agg', ',') AS placeholders, "
    + "CASE "
    + " ".join(f"WHEN regexp_matches(lower(file_path), '{'|'.join(t.replace('.', chr(92) + '.') for t in terms)}') THEN '{k}'" for k, terms in tools.PATH_CLASSES.items())
    + f" ELSE 'source' END AS path_class, substr(sha256({_V}), 1, 16) AS value_hash FROM det"
)
def tool_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections(spark, sf).select(
        "doc_id",
        tools.context_signals(F.col("context")).alias("s"),
        F.nullif(F.array_join(tools.placeholder_terms(F.col("matched_value")), ","), F.lit("")).alias("placeholders"),
        tools.path_class(F.col("file_path")).alias("path_class"),
        F.coalesce(T.value_hash(F.col("matched_value")), F.substring(F.sha2(F.lit(""), 256), 1, 16)).alias("value_hash"),
    )
    return rows.select("doc_id", "s.*", "placeholders", "path_class", "value_hash")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return triage.flat(triage.classify(detections(spark, sf)))


@query(f"WITH {DET}{CLS} SELECT doc_id, status, confidence, is_credentials, low AS skipped_model FROM dec")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("doc_id", "status", "confidence", "is_credentials", "skipped_model")


@query(f"""WITH {DET}{CLS} SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, count(*) AS total, count_if(is_credentials = 1) AS credentials, count_if(is_credentials <> 1) AS non_credentials,
  count_if(status = 'REAL') AS real, count_if(status = 'REVIEW') AS review, count_if(status = 'FALSE_POSITIVE') AS false_positive, 0::BIGINT AS json_invalid FROM dec GROUP BY 1""")
def owner_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.owner_summary(_classified(spark, sf))


@query(f"""WITH {DET}{CLS} SELECT owner, pattern_name AS file_path, count(*) AS total, count_if(is_credentials = 1) AS credentials
  FROM (SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, pattern_name, is_credentials FROM dec) GROUP BY ROLLUP (owner, pattern_name)""")
def owner_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return report.file_summary(_classified(spark, sf).withColumn("file_path", F.col("pattern_name")))


@query(f"""WITH {DET}{CLS} SELECT coalesce(nullif(owner, ''), 'unknown') AS owner, count(DISTINCT pattern_name) AS files, count(*) AS items FROM dec GROUP BY 1""")
def owner_report(spark: SparkSession, sf: str) -> DataFrame:
    nested = report.nested_report(clusters.written(_classified(spark, sf).withColumn("file_path", F.col("pattern_name")).drop("context")))
    each = nested.select("owner", F.col("summary.total").alias("total"), F.explode(F.map_keys("files")).alias("file"))
    return each.groupBy("owner").agg(F.countDistinct("file").alias("files"), F.max("total").alias("items"))


@query(f"""WITH {DET}{CLS} SELECT doc_id, CASE WHEN low THEN 'prefilter' ELSE 'model' END AS way, route FROM (SELECT *,
  CASE WHEN status = 'REVIEW' AND confidence < 0.4 THEN 'analyst' WHEN status = 'REVIEW' OR confidence BETWEEN 0.4 AND 0.6 THEN 'self_consistency' WHEN confidence < 0.85 THEN 'react' ELSE 'accept' END AS route FROM dec)""")
def routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.route(_classified(spark, sf))
    return rows.select("doc_id", F.when(F.col("skipped_model"), "prefilter").otherwise("model").alias("way"), "route")


@query(f"""WITH {DET}{CLS} SELECT doc_id, CASE WHEN harmless THEN 'FALSE_POSITIVE' WHEN likely THEN 'REAL' ELSE 'REVIEW' END AS status, NOT harmless AND NOT likely AS escalated,
  CASE WHEN NOT harmless AND NOT likely THEN 0 END::BIGINT AS votes_real, (CASE WHEN NOT harmless AND NOT likely THEN 5 ELSE 1 END)::INT AS samples FROM dec""")
def self_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.self_consistency(detections(spark, sf), "doc_id")
    return rows.select("doc_id", "decision.status", "escalated", "votes_real", F.size("sample_statuses").alias("samples"))


@query(f"""WITH {DET}{CLS} SELECT doc_id, CASE WHEN harmless THEN 'FALSE_POSITIVE' WHEN likely THEN 'REAL' ELSE 'REVIEW' END AS status,
  (CASE WHEN ph THEN 2 ELSE 3 END)::INT AS steps, (CASE WHEN ph THEN 1 ELSE 2 END)::INT AS calls, 'final' AS terminated
  FROM (SELECT *, len(list_filter({list(tools.PLACEHOLDER_TERMS)}, lambda t: contains(lower({_V}), t))) > 0 AS ph FROM dec)""")
def react_loop(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.react(detections(spark, sf))
    return rows.select("doc_id", "decision.status", "steps", F.size("tool_calls").alias("calls"), "terminated")


@query(f"WITH {DET} SELECT doc_id, sha256({PROMPT}) AS prompt_hash, matched_value AS value_back, pattern_name AS pattern_back, 10::INT AS messages FROM det")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = T.prompt(*[F.col(c) for c in ("file_path", "source", "pattern_name", "matched_value", "context")])
    rows = detections(spark, sf).select("doc_id", p.alias("p"), F.size(triage.messages(p)).alias("messages"))
    return rows.select("doc_id", F.sha2("p", 256).alias("prompt_hash"), T.prompt_field(F.col("p"), "matched_value").alias("value_back"), T.prompt_field(F.col("p"), "pattern_name").alias("pattern_back"), "messages")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of false positives from documents."""
    rows = detections(spark, sf).select(F.lit("documents").alias("source_file"), F.col("doc_id").alias("source_index"), "context", F.col("owner").alias("username"), F.col("matched_value").alias("password"))
    return records.make_records(rows, "FALSE_POSITIVE")


_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
REC = rf"""{DET},
rec AS (SELECT printf('fp-%06d', doc_id) AS record_id, doc_id, ctx AS context, nullif(owner, '') AS username, CASE WHEN pw NOT IN ('', 'None', 'null', 'NULL') THEN pw END AS password,
  'sha256:' || sha256(ctx) AS h FROM (SELECT *, substr(regexp_replace(context, '^{_WS}|{_WS}$', '', 'g'), 1, 600) AS ctx,
  CASE WHEN s NOT IN ('', 'None', 'null', 'NULL') THEN nullif(CASE WHEN (starts_with(s, '"') AND ends_with(s, '"')) OR (starts_with(s, '''') AND ends_with(s, '''')) THEN substr(s, 2, greatest(length(s) - 2, 0)) ELSE s END, '') END AS pw
  FROM (SELECT *, regexp_replace(matched_value, ',+$', '') AS s FROM det)))"""


@query(f"WITH {REC} SELECT record_id, context, username, password, h AS source_context_hash, 'FALSE_POSITIVE' AS status, 0::INT AS is_credentials FROM rec")
def make_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("record_id", "context", "username", "password", "source_context_hash", "status", "is_credentials")


@query(f"""WITH {REC} SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY h, password ORDER BY sha256('42|' || record_id), record_id) AS r FROM rec) WHERE r = 1""")
def first_of_key(spark: SparkSession, sf: str) -> DataFrame:
    return records.first_of_key(_records(spark, sf)).select("record_id")


@query(f"""WITH {REC}, g AS (SELECT h, row_number() OVER (ORDER BY sha256('42|' || h), h) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT h FROM rec))
  SELECT record_id, CASE WHEN p < floor(n * 0.1) THEN 'test' WHEN p < floor(n * 0.1) + floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM rec JOIN g USING (h)""")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return records.assign_splits(_records(spark, sf)).select("record_id", "split")


@query("SELECT NULL::VARCHAR AS source_context_hash WHERE false")
def leaked_groups(spark: SparkSession, sf: str) -> DataFrame:
    return records.leaked_groups(records.assign_splits(_records(spark, sf)))


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('42|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 500""")
def class_cap(spark: SparkSession, sf: str) -> DataFrame:
    return records.cap_per_class(_table(spark, sf, "orders"), 500, class_col="o_orderstatus", id_col="o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM orders GROUP BY 1")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return records.class_weights(_table(spark, sf, "orders"), "o_orderpriority").withColumn("weight", _r("weight"))


def _draw(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15))::BIGINT % {n})"


def _pick(options: tuple, *parts: str) -> str:
    items = ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options)
    return f"list_extract([{items}], {_draw(str(len(options)), *parts)}::INT + 1)"


def _hex(*parts: str) -> str:
    h = f"sha256({" || '|' || ".join(parts)})"
    uuid_ = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    kind = _draw("3", "'kind'", *parts)
    return f"CASE {kind} WHEN 0 THEN {uuid_} WHEN 1 THEN substr({h}, 1, 40) ELSE {h} END"


_TOKENS = " || ".join(f"regexp_extract_all(context, '{p}')" for p in augment.TOKEN_PATTERNS)


@query(f"""WITH {REC}, pool AS (SELECT 'secret-' || c_custkey AS v, row_number() OVER (ORDER BY substr(md5('secret-' || c_custkey), 1, 3), 'secret-' || c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
  k AS (SELECT *, {_TOKENS} AS toks FROM rec), t AS (SELECT *, list_extract(toks, {_draw("greatest(len(toks), 1)", "'42'", "'token'", "record_id")}::INT + 1) AS tok FROM k),
  v AS (SELECT record_id, CASE WHEN {_draw("1000", "'42'", "'easy'", "record_id")} < 500 THEN {{'s': 'none', 'k': 'none_literal', 'v': {_pick(augment.NONE_LITERALS, "'42'", "'none'", "record_id")}}} ELSE {{'s': 'placeholder', 'k': 'placeholder', 'v': {_pick(augment.PLACEHOLDERS, "'42'", "'placeholder'", "record_id")}}} END AS x FROM t
    UNION ALL SELECT record_id, CASE WHEN tok IS NOT NULL AND {_draw("1000", "'42'", "'medium'", "record_id")} < 700 THEN {{'s': 'context-token', 'k': 'context_token', 'v': tok}} ELSE {{'s': 'dictionary', 'k': 'dictionary_word', 'v': {_pick(augment.DICTIONARY_WORDS, "'42'", "'word'", "record_id")}}} END FROM t
    UNION ALL SELECT record_id, CASE WHEN {_draw("1000", "'42'", "'hard'", "record_id")} < 500 THEN {{'s': 'high-entropy', 'k': 'high_entropy_non_secret', 'v': {_hex("'42'", "record_id")}}} ELSE {{'s': 'hard-negative', 'k': 'hard_negative', 'v': (SELECT v FROM pool WHERE i = {_draw("n", "'42'", "'pool'", "record_id")})}} END FROM t)
  SELECT record_id || '-aug-' || x.s AS record_id, x.k AS distractor_type, x.v AS password, record_id AS augmentation_parent_id, round({ENT.format("x.v")}, 6) AS entropy FROM v""")
def augmentation(spark: SparkSession, sf: str) -> DataFrame:
    real = _table(spark, sf, "customer").select(F.concat(F.lit("secret-"), F.col("c_custkey").cast("string")).alias("password"), F.col("c_custkey").cast("string").alias("record_id"))
    out = augment.augment_false_positives(_records(spark, sf), augment.password_pool(real))
    return out.select("record_id", "distractor_type", "password", "augmentation_parent_id", _r("features.entropy").alias("entropy"))


@query(f"""WITH {REC}, why AS (SELECT 'fp-' || lpad(doc_id::VARCHAR, 6, '0') AS record_id, 'quality ' || quality AS reasoning FROM labels)
  SELECT record_id, sha256('File: synthetic/training_sample | Source: documents' || chr(10) || 'Pattern: PASSWORD | Match: ' || coalesce(password, 'None') || chr(10) || 'Context:' || chr(10)
    || CASE WHEN username IS NOT NULL AND NOT contains(context, 'username=' || username) THEN 'username=' || username || chr(10) ELSE '' END || context) AS prompt_hash,
    coalesce(why.reasoning, 'Labelled as a false positive by its source.') AS reasoning,
    (CASE WHEN username IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN {ENT.format("password")} >= 3.5 THEN 1 ELSE 0 END + 1)::INT AS evidence FROM rec LEFT JOIN why USING (record_id)""")
def prompt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    why = _table(spark, sf, "labels").select(F.concat(F.lit("fp-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("record_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reasoning"), F.array().cast("array<string>").alias("evidence"))
    pairs = records.prompt_pairs(_records(spark, sf), why).withColumn("c", jsonx.raw_fields(F.col("completion")))
    return pairs.select("record_id", F.sha2("prompt", 256).alias("prompt_hash"), "c.reasoning", F.size(jsonx.text_list(F.col("c.evidence"))).alias("evidence"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id").join(_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH {REC} SELECT record_id, 'FALSE_POSITIVE' AS status, 'original' AS distractor_type, replace(substr(coalesce(password, 'None'), 1, 40), chr(10), ' ') AS password,
  printf('%.3f', {ENT.format("password")}) AS entropy, replace(substr(context, 1, 120), chr(10), ' ') AS context FROM rec""")
def inspection(spark: SparkSession, sf: str) -> DataFrame:
    return writers.inspection(_records(spark, sf)).select("record_id", "status", "distractor_type", "password", "entropy", "context")


@query(f"""WITH {DET} SELECT doc_id, substr(sha256(matched_value), 1, 16) AS value_hash, coalesce(doc_id > min(doc_id) OVER (PARTITION BY matched_value) AND matched_value IS NOT NULL, false) AS is_duplicate FROM det""")
def duplicate_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.mark_duplicates(detections(spark, sf), "doc_id").select("doc_id", "value_hash", "is_duplicate")


@query(f"""WITH {DET} SELECT substr(sha256(matched_value), 1, 16) AS value_hash, count(*) AS n, count(DISTINCT owner) AS owners, count(DISTINCT file_path) AS files FROM det WHERE matched_value IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.duplicate_groups(detections(spark, sf))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_nationkey * 1000 + floor(s_acctbal / 500)::INT AS a, floor(s_acctbal / 250)::INT * 7 + s_suppkey % 7 AS b FROM supplier),
  e AS (SELECT x.id AS u, y.id AS v FROM s x JOIN s y ON x.a = y.a UNION SELECT x.id, y.id FROM s x JOIN s y ON x.b = y.b),
  r AS (SELECT id AS u, id AS v FROM s UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS id, min(v) AS cluster FROM r GROUP BY u""")
def entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "supplier")
    rows = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 1000 + F.floor(F.col("s_acctbal") / 500)).alias("a"), (F.floor(F.col("s_acctbal") / 250) * 7 + F.col("s_suppkey") % 7).alias("b"))
    return clusters.entity_clusters(rows, "id", ("a", "b"))


_ANSWER = """CASE event_id % 6 WHEN 0 THEN '{"status": "REAL", "is_credentials": 1, "confidence": ' || value || ', "reasoning": "r", "evidence": ["near host", "x"], "agent_trace": {}}'
  WHEN 1 THEN 'text before {"status": "false positive", "is_credentials": false, "confidence": 0.25} after' WHEN 2 THEN '{"status": "REVIEW", "is_credentials": true, "evidence": "single"}'
  WHEN 3 THEN 'no object here, REVIEW' WHEN 4 THEN '[1, 2]' ELSE '{"status": "odd", "confidence": "high", "reasoning": ""}' END"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", F.expr(_ANSWER.replace("|| value ||", "|| cast(value AS string) ||")).alias("answer"))


@query("""SELECT event_id, list_extract(['REAL', 'FALSE_POSITIVE', 'REAL', 'REVIEW', 'REVIEW', 'REVIEW'], k) AS status, list_extract([1, 0, 1, 0, 0, 0], k)::INT AS is_credentials,
  CASE k WHEN 1 THEN greatest(0, least(1, value)) WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence, k NOT IN (4, 5) AS json_valid, k = 1 AND value BETWEEN 0 AND 1 AS schema_ok,
  list_extract([2, 0, 1, 1, 1, 0], k)::INT AS evidence, list_extract(['REAL', 'REVIEW', 'REVIEW', 'REVIEW', 'REVIEW', 'REVIEW'], k) AS extracted FROM (SELECT event_id, value, (event_id % 6)::INT + 1 AS k FROM events)""")
def json_decisions(spark: SparkSession, sf: str) -> DataFrame:
    obj = jsonx.json_object(F.col("answer"))
    rows = _answers(spark, sf).withColumn("obj", obj).withColumn("d", jsonx.decision(F.col("obj"), F.lit("direct_json"), F.lit("m")))
    return rows.select("event_id", "d.status", "d.is_credentials", "d.confidence", "d.json_valid", jsonx.schema_valid(F.col("obj")).alias("schema_ok"), F.size("d.evidence").alias("evidence"), jsonx.extract_status(F.col("answer")).alias("extracted"))


@query(f"""WITH {DET} SELECT doc_id, round((1 + CASE WHEN length(lower(owner)) >= 3 AND contains(lower(context || ' ' || coalesce(matched_value, '') || ' ' || file_path), lower(owner)) THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(context || ' ' || coalesce(matched_value, '') || ' ' || file_path), 'token') THEN 1 ELSE 0 END) / 3.0, 6)::DOUBLE AS grounding FROM det""")
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    evidence = F.array(F.lit("near value"), F.coalesce("owner", F.lit("")), F.lit("a token, :"))
    text = jsonx.grounding_text(F.col("context"), F.col("matched_value"), F.col("file_path"))
    return detections(spark, sf).select("doc_id", _r(jsonx.grounding_score(evidence, text)).alias("grounding"))


def _bench_sql(by: str = "", group: str = "ALL", src: str = "") -> str:
    return "WITH " + BENCH.replace("{by}", by).replace("{group}", group).replace("{src}", src)


_SCORES = ["tp", "tn", "fp", "fn", "n", "precision", "recall", "accuracy", "f1", "specificity"]
_SCORES_SQL = "tp, tn, fp, fn, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(specificity, 6) AS specificity"


def _scored(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, *_SCORES[:5], *[_r(c).alias(c) for c in _SCORES[5:]])


@query(_bench_sql("model, strategy,", "model, strategy") + f" SELECT model, strategy, {_SCORES_SQL} FROM sc")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(metrics.binary_metrics(bench(spark, sf), "model", "strategy", true="expected_is_credentials", pred="predicted_is_credentials"), "model", "strategy")


@query(_bench_sql("slice,", "slice") + f" SELECT slice, {_SCORES_SQL} FROM sc")
def slice_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = bench(spark, sf).withColumn("expected_binary", F.col("expected_is_credentials")).withColumn("predicted_binary", F.col("predicted_is_credentials"))
    return _scored(metrics.slice_metrics(rows), "slice")


@query(
    _bench_sql("dimension, value,", "dimension, value", ", (SELECT unnest(['model', 'strategy', 'json_valid']) AS dimension) d, LATERAL (SELECT CASE dimension WHEN 'model' THEN model WHEN 'strategy' THEN strategy ELSE json_valid::VARCHAR END AS value) z")
    + f" SELECT dimension, value, {_SCORES_SQL} FROM sc"
)
def dimension_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = bench(spark, sf).withColumn("expected_binary", F.col("expected_is_credentials")).withColumn("predicted_binary", F.col("predicted_is_credentials"))
    return _scored(metrics.dimension_slices(rows, {c: F.col(c) for c in ("model", "strategy", "json_valid")}), "dimension", "value")


@query(_bench_sql("", "ALL").split(",\nagg AS")[0] + """, l AS (SELECT unnest(['REAL', 'FALSE_POSITIVE', 'REVIEW']) AS label),
  c AS (SELECT label, count_if(expected_status = label AND predicted_status = label) AS tp, count_if(expected_status <> label AND predicted_status = label) AS fp, count_if(expected_status = label AND predicted_status <> label) AS fn,
    count_if(expected_status = label) AS support, count_if(expected_status = predicted_status) / count(*) AS accuracy FROM bench, l GROUP BY label),
  s AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c))
  SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(sum(f1) OVER () / 3, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM s""")
def multiclass_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.multiclass_metrics(bench(spark, sf))
    return rows.select("label", F.col("support").cast("long").alias("support"), *[_r(c).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")])


_ONLY_BENCH = _bench_sql("", "ALL").split(",\nagg AS")[0]


@query(_ONLY_BENCH + " SELECT expected_status, predicted_status, count(*) AS count FROM bench GROUP BY 1, 2")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(bench(spark, sf))


@query(_ONLY_BENCH + """ SELECT model, strategy, q::DOUBLE AS percent, s[round_even(q / 100.0 * (len(s) - 1), 0)::INT + 1] AS value
  FROM (SELECT model, strategy, list_sort(list(latency_ms)) AS s FROM bench WHERE latency_ms IS NOT NULL GROUP BY 1, 2), (SELECT unnest([50, 95, 99]) AS q)""")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(bench(spark, sf), ["model", "strategy"], "latency_ms", [50, 95, 99])


@query("""SELECT q::DOUBLE AS percent, s[round_even(q / 100.0 * (len(s) - 1), 0)::INT + 1] AS value FROM (SELECT list_sort(list(l_extendedprice)) AS s FROM lineitem WHERE l_extendedprice IS NOT NULL), (SELECT unnest([0, 50, 95, 99, 100]) AS q)""")
def price_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(_table(spark, sf, "lineitem"), [], "l_extendedprice", [0, 50, 95, 99, 100])


@query(_bench_sql("model, strategy,", "model, strategy") + """, x AS (SELECT model, strategy, count_if(distractor_type = 'hard_negative') AS hn,
    count_if(distractor_type = 'hard_negative' AND expected_is_credentials = 0 AND predicted_is_credentials = 0) AS hc, count_if(distractor_type = 'hard_negative' AND expected_is_credentials = 0) AS h0,
    avg(json_valid::INT) AS jv, avg(schema_valid::INT) AS sv, avg(evidence_grounding) AS eg, avg(latency_ms) AS lat, avg((predicted_status = 'REVIEW')::INT) AS rr, avg(escalated::INT) AS er,
    list_sort(list(latency_ms)) AS s FROM bench GROUP BY 1, 2)
  SELECT model, strategy, n, round(f1, 6) AS f1, CASE WHEN hn > 0 THEN round(coalesce(hc / nullif(h0, 0), 0), 6) END AS hard_negative_specificity, round(jv, 6) AS json_valid_rate, round(sv, 6) AS schema_valid_rate, round(eg, 6) AS evidence_grounding,
    round(lat, 6) AS avg_latency_ms, s[round_even(0.95 * (len(s) - 1), 0)::INT + 1] AS p95_latency_ms, round(rr, 6) AS review_rate, round(er, 6) AS escalation_rate FROM sc JOIN x USING (model, strategy)""")
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.benchmark_summary(bench(spark, sf))
    rounded = [_r(c).alias(c) for c in ("f1", "hard_negative_specificity", "json_valid_rate", "schema_valid_rate", "evidence_grounding", "avg_latency_ms")]
    return s.select("model", "strategy", "n", *rounded, "p95_latency_ms", *[_r(c).alias(c) for c in ("review_rate", "escalation_rate")])


@query(_ONLY_BENCH + """, a AS (SELECT model, strategy, avg(latency_ms) AS l FROM bench GROUP BY 1, 2)
  SELECT a.model, a.strategy, round(a.l / b.l, 6) AS cost_multiplier FROM a JOIN a b ON a.model = b.model AND b.strategy = 'direct_json'""")
def cost_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.cost_multiplier(metrics.benchmark_summary(bench(spark, sf)))
    return s.select("model", "strategy", _r("cost_multiplier").alias("cost_multiplier"))


@query(_bench_sql("model, strategy,", "model, strategy") + ", l AS (SELECT model, strategy, avg(latency_ms) AS l FROM bench GROUP BY 1, 2) SELECT model, strategy, f1 >= 0.7 AS passed, CASE WHEN f1 >= 0.7 THEN row_number() OVER (PARTITION BY f1 >= 0.7 ORDER BY f1 DESC, l, model, strategy) END::INT AS rank FROM sc JOIN l USING (model, strategy)")
def promotion(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.promotion(metrics.benchmark_summary(bench(spark, sf)), {"f1": 0.7})
    return out.select("model", "strategy", (F.size("failed_gates") == 0).alias("passed"), "rank")


@query(_ONLY_BENCH + """, s AS (SELECT model, strategy, avg((expected_is_credentials = predicted_is_credentials)::INT) AS b, avg((expected_is_credentials = predicted_is_credentials)::INT) FILTER (json_valid) AS a FROM bench GROUP BY 1, 2)
  SELECT model, strategy, round(b, 6) AS before, round(a, 6) AS after, b - a > 0.02 AS blocked FROM s""")
def canary(spark: SparkSession, sf: str) -> DataFrame:
    rows = bench(spark, sf)
    c = metrics.canary(metrics.benchmark_summary(rows), metrics.benchmark_summary(rows.filter("json_valid")), "accuracy")
    return c.select("model", "strategy", _r("before").alias("before"), _r("after").alias("after"), "blocked")


@query(_ONLY_BENCH + " SELECT coalesce(nullif(distractor_type, ''), 'original') AS value, count(*) AS count FROM bench GROUP BY 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.value_counts(bench(spark, sf), "distractor_type", "original")


@query(f"""WITH {DET}, s AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct(regexp_extract_all(context, '{p}', 1))) AS value FROM det" for k, p in synth.MINED.items())})
  SELECT kind, value, count(*) AS n FROM s GROUP BY 1, 2""")
def mined_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return synth.mine_vocabulary(detections(spark, sf).select(F.col("context").alias("text")))


class _DuckInk(synth.Ink):
    """The generator's rows in DuckDB's SQL."""

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def draw(self, n: int, slot: str, *more: str) -> str:
        return f"(('0x' || substr(md5(concat_ws('|', '{self.seed}', '{slot}', n{''.join(', ' + m for m in more)})), 1, 15))::BIGINT % {n})"

    def bind(self, value: str, name: str, body: str) -> str:
        return f"list_extract(list_transform([{value}], lambda {name}: {body}), 1)"

    def pick(self, options, slot: str) -> str:
        return f"list_extract([{', '.join(map(self.lit, options))}], {self.draw(len(options), slot)}::INT + 1)"

    def text(self, alphabet: str, n: int, slot: str) -> str:
        return f"array_to_string(list_transform(range(1, {n + 1}), lambda i: substr({self.lit(alphabet)}, ({self.draw(len(alphabet), slot, 'i')} + 1)::INT, 1)), '')"


_MINED = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) AS value FROM documents" for k, p in synth.MINED.items())


def _generated(wanted: dict[str, str], seed: int = 42, extra: float = 1.5) -> str:
    """SQL of ``synth.generate`` with words mined from ``documents``, where the first attempt has rows enough; the wanted numbers
    are SQL."""
    every = []
    for rank, (label, n) in enumerate(wanted.items()):
        joins = " ".join(f"LEFT JOIN voc v_{k} ON v_{k}.kind = '{k}' AND v_{k}.i = {_draw(f'v_{k}.size', f"'{seed}'", f"'{label}'", "'mined'", f"'{k}'", 'b.n')}" for k in synth.MINED)
        rows = "SELECT b.n, " + ", ".join(f"v_{k}.value AS mined_{k}" for k in synth.MINED) + f" FROM (SELECT unnest(range((SELECT floor({n} * {extra})::BIGINT + 20 FROM size))) AS n) b {joins}"
        for stage in synth.LABELS[label](synth.Writer(_DuckInk(seed))):
            rows = "SELECT *, " + ", ".join(f"{text} AS {name}" for name, text in stage.items()) + f" FROM ({rows})"
        every.append(f"SELECT n, substr(context, 1, {synth.CONTEXT_CHARS}) AS context, nullif(username, '') AS username, nullif(password, '') AS password, '{label}' AS label, category, {rank} AS rank, (SELECT {n} FROM size) AS wanted FROM ({rows})")
    return f"""WITH size AS (SELECT count(*) AS docs FROM documents), voc AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY substr(md5(value), 1, 3), value) - 1 AS i, count(*) OVER (PARTITION BY kind) AS size FROM (SELECT DISTINCT kind, value FROM ({_MINED}))),
  every AS ({" UNION ALL ".join(every)}),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY rank, n) AS k FROM every) WHERE k = 1)
  SELECT context, username, password, label, category FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n) AS place FROM uniq) WHERE place <= wanted"""


@query(_generated({"REAL": "4 * docs", "FALSE_POSITIVE": "4 * docs", "REVIEW": "docs * 7 // 10"}))
def synthetic_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in numbers that follow the documents', with the words that documents hold."""
    docs = _table(spark, sf, "documents")
    n = docs.count()
    return synth.generate(spark, 4 * n, 4 * n, n * 7 // 10, vocabulary=clusters.written(synth.mine_vocabulary(docs)))


@query(f"""WITH {REC}, run AS (SELECT record_id, 'synthetic/training_sample' AS file_path, 'documents' AS source, 'PASSWORD' AS pattern_name, coalesce(password, 'None') AS matched_value, context FROM rec),
  s AS (SELECT CASE WHEN {_HARMLESS} THEN 'FALSE_POSITIVE' WHEN {_LIKELY} THEN 'REAL' ELSE 'REVIEW' END AS status FROM run)
  SELECT 'native' AS model, strategy, count(*) AS n, 0::BIGINT AS tp, count_if(status <> 'REAL') AS tn, count_if(status = 'REAL') AS fp, 0::BIGINT AS fn, round(avg((status = 'REVIEW')::INT), 6) AS review_rate, 1.0::DOUBLE AS json_valid_rate,
    CASE WHEN strategy = 'self_consistency' THEN round(avg((status = 'REVIEW')::INT), 6) END AS escalation_rate FROM s, (SELECT unnest({list(triage.STRATEGIES)}) AS strategy) GROUP BY strategy""")
def strategy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every strategy on the records of all documents."""
    rows = clusters.written(benchmark.bench_rows(_records(spark, sf), {"native": triage.native_provider}))
    return metrics.benchmark_summary(rows).select("model", "strategy", "n", "tp", "tn", "fp", "fn", *[_r(c).alias(c) for c in ("review_rate", "json_valid_rate", "escalation_rate")])


def _streamed(spark: SparkSession, sf: str, name: str, make: Callable[[DataFrame], DataFrame], complete: bool) -> DataFrame:
    base = f"{clusters.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a file or a folder.
    rows = make(spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]"))
    run = streams.write_counts(rows, f"{base}/out", f"{base}/state") if complete else streams.write_stream(rows, f"{base}/out", f"{base}/state")
    run.awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in out.dtypes if t == "timestamp"})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "events", lambda d: streams.windowed_counts(d, "ts", "event_type", late="400 days"), True)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events),
  h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM h GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "events", lambda d: streams.owner_sessions(d, "ts", "user_id", late="400 days"), True)


def _files_of_events(spark: SparkSession, sf: str, files: int = 6) -> str:
    """``events`` in several files, not in order of time; a last row of a far day moves the watermark behind all others."""
    base = f"{clusters.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    dealt = events.repartition(files, F.crc32(F.col("event_id").cast("string")))
    dealt.write.parquet(f"{base}/in")
    end = events.agg(F.lit(-1).cast("long").alias("event_id"), F.coalesce(F.max("ts"), F.lit(0).cast("timestamp")).alias("ts")).withColumn("ts", F.expr("ts + INTERVAL 1000 DAYS"))
    end.select("event_id", "ts", F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value")).write.mode("append").parquet(f"{base}/in")
    return base


_EVENT = "event_id long, ts timestamp, event_type string, value double"


def _in_batches(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of ``events``, one file a batch."""
    base = _files_of_events(spark, sf)
    rows = make(streams.read_stream(spark, f"{base}/in", _EVENT, files=1))
    streams.write_stream(rows, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of days, of which each batch writes what it changes; the last word on every day is the count of all rows."""
    base = _files_of_events(spark, sf)
    rows = streams.windowed_counts(streams.read_stream(spark, f"{base}/in", _EVENT, files=1), "ts", "event_type", "1 day", late="900 days")
    streams.write_updates(rows, f"{base}/out", f"{base}/state").awaitTermination()
    out = streams.latest(spark, f"{base}/out", "window_start", "event_type").filter("event_type <> 'end'")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id AS id, substr(sha256(event_type), 1, 16) AS value_hash, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 1 AS is_duplicate FROM events")
def stream_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Few values of many rows, in batches that are out of order: the first row is the first by time all the same."""
    return _in_batches(spark, sf, lambda d: streams.mark_duplicates(d.withColumn("matched_value", F.col("event_type")), "ts", late="900 days"))


@query("SELECT DISTINCT substr(sha256(event_type || ':' || floor(value / 10)::BIGINT), 1, 16) AS value_hash FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Every value once, whatever batch it comes in."""
    named = F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("string"))
    rows = _in_batches(spark, sf, lambda d: streams.distinct_values(d.filter("event_type IS NOT NULL AND value IS NOT NULL").withColumn("matched_value", named), "ts", late="900 days"))
    return rows.select("value_hash")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(value) AS n, round(avg(value), 6) AS mean, true AS p50_holds, true AS p95_holds FROM events GROUP BY 1 HAVING count(value) > 0")
def stream_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of days from the sketches of hours that a stream writes; each is held against the exact ranks of its day."""
    hours = _in_batches(spark, sf, lambda d: streams.window_sketches(d, "ts", "value", "1 hour", late="900 days"))
    days = streams.merged_quantiles(clusters.written(hours), "1 day", (50, 95))
    exact = _table(spark, sf, "events").filter("value IS NOT NULL").select(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("day"), "value")
    below = lambda p: F.avg((F.col("value") < F.col(p)).cast("int")) - 0.05  # noqa: E731  three times the sketch's error
    upto = lambda p: F.avg((F.col("value") <= F.col(p)).cast("int")) + 0.05
    held = days.join(exact, F.col("window_start") == F.col("day")).groupBy("window_start", "n", "mean")
    held = held.agg(*[((below(f"p{q}") <= q / 100) & (upto(f"p{q}") >= q / 100)).alias(f"p{q}_holds") for q in (50, 95)])
    return held.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", _r("mean").alias("mean"), "p50_holds", "p95_holds")

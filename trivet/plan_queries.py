"""Queries of whole plans and of what surrounds them: merged datasets, limits, prompts of strategies, retries, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.functions import tools
from trivet.io_queries import _folder
from trivet.operators import augment, metrics, records, triage
from trivet.plans import benchmark, dataset
from trivet.queries import DET, ORACLES, PROMPT, REC, _bench_sql, _r, _records, _table, bench, detections, query
from trivet.sources import readers, writers

_VARIANTS = ORACLES["augmentation"].rsplit("SELECT record_id || '-aug-'", 1)[0]
_CONTEXT = "'customer ' || c_custkey || ' uses secret-' || c_custkey"


def _true_positives(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    secret = F.concat(F.lit("secret-"), key)
    rows = _table(spark, sf, "customer").select(F.lit("customers").alias("source_file"), F.col("c_custkey").alias("source_index"), F.concat(F.lit("customer "), key, F.lit(" uses "), secret).alias("context"), F.lit(None).cast("string").alias("username"), secret.alias("password"))
    return records.make_records(rows, "REAL")


@query(f"""{_VARIANTS}, every AS (SELECT record_id, h, password, 'FALSE_POSITIVE' AS status, NULL::VARCHAR AS d FROM rec
    UNION ALL SELECT v.record_id || '-aug-' || x.s, h, x.v, 'FALSE_POSITIVE', x.k FROM v JOIN rec USING (record_id)
    UNION ALL SELECT printf('tp-%06d', c_custkey), 'sha256:' || sha256({_CONTEXT}), 'secret-' || c_custkey, 'REAL', NULL FROM customer
    UNION ALL SELECT printf('rv-%06d', s_suppkey), 'sha256:' || sha256('supplier ' || s_suppkey), NULL, 'REVIEW', NULL FROM supplier)
  SELECT record_id, status, d AS distractor_type FROM (SELECT *, row_number() OVER (PARTITION BY h, password, status, d ORDER BY sha256('42|' || record_id), record_id) AS r FROM every) WHERE r = 1""")
def merged_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all labels and variants, one of each key; more than three variants are three."""
    key = F.col("s_suppkey")
    reviews = _table(spark, sf, "supplier").select(F.lit("suppliers").alias("source_file"), key.alias("source_index"), F.concat(F.lit("supplier "), key.cast("string")).alias("context"), *[F.lit(None).cast("string").alias(c) for c in ("username", "password")])
    rows = dataset.merged(_true_positives(spark, sf), _records(spark, sf), records.make_records(reviews, "REVIEW"), per_parent=9)
    return rows.select("record_id", "status", "distractor_type")


@query(f"{_VARIANTS} SELECT record_id || '-aug-' || x.s AS record_id, x.k AS distractor_type FROM v WHERE x.s IN ('none', 'placeholder')")
def first_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The easiest variant of each record only."""
    return augment.augment_false_positives(_records(spark, sf), None, 1).select("record_id", "distractor_type")


@query(f"WITH {REC} SELECT 25 AS wanted, record_id FROM (SELECT record_id FROM rec ORDER BY record_id LIMIT 25) UNION ALL SELECT 0, record_id FROM rec")
def limited_records(spark: SparkSession, sf: str) -> DataFrame:
    """A limit takes the first by id; no limit takes all."""
    rows = _records(spark, sf).select("record_id")
    part = lambda n: records.first_records(rows, n).select(F.lit(n).alias("wanted"), "record_id")
    return part(25).unionByName(part(0))


@query("SELECT doc_id, quality FROM labels")
def source_autodetect(spark: SparkSession, sf: str) -> DataFrame:
    """A source found by its stem among others in a folder."""
    folder = _folder(spark)
    rows = _table(spark, sf, "labels").select("doc_id", "quality")
    writers.write_json_lines(rows, f"{folder}/labels (1)")
    writers.write_json_lines(rows.limit(0), f"{folder}/labels of others")
    quality = dict(rows.dtypes)["quality"]
    return readers.read_json_lines(spark, readers.first_existing(spark, folder, "labels"), f"doc_id bigint, quality {quality}")


_SUFFIXES = {
    "direct_json": "", "few_shot": "\n\nAnswer as in the examples, with the JSON object only.", "cot_distilled": "\n\nGive short reasons and evidence; no hidden reasoning.",
    "self_consistency": "", "react_triage": "\n\nOne JSON object a turn: a tool call or the final answer.",
}
_q = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"WITH {DET}" + " UNION ALL ".join(f" SELECT doc_id, '{k}' AS strategy, sha256({PROMPT} || {_q(v)}) AS prompt_hash, sha256({_q(triage.REACT_SYSTEM if k == 'react_triage' else triage.SYSTEM)}) AS system_hash FROM det" for k, v in _SUFFIXES.items()))
def strategy_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What each strategy asks, and its system text."""
    parts = [triage._prompted(detections(spark, sf), k).select("doc_id", F.lit(k).alias("strategy"), F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("system", 256).alias("system_hash")) for k in _SUFFIXES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Qwen/Qwen2.5-Coder-3B-Instruct' WHEN 1 THEN 'ibm-granite/granite-3.3-2b-instruct' WHEN 2 THEN 'meta-llama/Llama-3.2-3B-Instruct' ELSE p_brand END AS hub_id FROM part")
def hub_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Names of models by a part of them; others stay as they are."""
    name = F.get(F.array(*map(F.lit, ("my-QWEN-3b", "granite_small", "Llama at home"))), (F.col("p_partkey") % 4).cast("int"))
    return _table(spark, sf, "part").select("p_partkey", benchmark.hub_ids(F.coalesce(name, "p_brand")).alias("hub_id"))


@query("SELECT (o_orderkey % 50)::VARCHAR AS value, count(*) AS n, CASE WHEN o_orderkey % 50 % 3 = 0 THEN 'REVIEW' ELSE 'REAL' END AS status, o_orderkey % 50 % 3 <> 0 AS json_valid FROM orders GROUP BY o_orderkey % 50")
def retried_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without an object are asked for once more; values that never get one are REVIEW."""
    fixed = {c: F.lit(c) for c in ("file_path", "source", "pattern_name", "context")}
    rows = _table(spark, sf, "orders").select((F.col("o_orderkey") % 50).cast("string").alias("matched_value")).withColumns(fixed)
    asked: dict[str, int] = {}

    def model(prompt: str, *_: object) -> str:
        value = int(prompt.split("Match: ")[1].split("\n")[0])
        asked[prompt] = asked.get(prompt, 0) + 1
        return '{"status": "REAL", "is_credentials": 1}' if value % 3 == 2 or value % 3 == 1 and asked[prompt] > 1 else "no object"

    d = triage.ask(rows, triage.callable_provider(model)).groupBy(F.col("matched_value").alias("value"), "decision.status", "decision.json_valid")
    return d.agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of categories as a sorted map for each label."""
    counts = _table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").count()
    listed = F.sort_array(F.collect_list(F.struct("o_orderstatus", "count")))  # a few categories
    return counts.groupBy("o_orderpriority").agg(F.to_json(F.map_from_entries(listed)).alias("counts"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def leaked_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that a split by rows has torn apart."""
    rows = _table(spark, sf, "orders").withColumn("split", (F.col("o_orderkey") % 3).cast("string"))
    return records.leaked_groups(rows, "o_custkey")


@query(_bench_sql("model, strategy,", "model, strategy") + " SELECT row_number() OVER (ORDER BY model, strategy) - 1 AS place, model, strategy, n FROM sc")
def summary_order(spark: SparkSession, sf: str) -> DataFrame:
    """A summary's rows are in order of model and strategy."""
    rows = metrics.benchmark_summary(bench(spark, sf)).select("model", "strategy", "n").coalesce(1)
    return rows.withColumn("place", F.monotonically_increasing_id())


@query(_bench_sql("model,", "model") + " SELECT model, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round((recall + specificity) / 2, 6) AS balanced_accuracy FROM sc")
def error_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.binary_metrics(bench(spark, sf), "model", true="expected_is_credentials", pred="predicted_is_credentials")
    return rows.select("model", *[_r(c).alias(c) for c in ("fpr", "fnr", "balanced_accuracy")])


@query("SELECT o_orderkey, substr(sha256('c' || o_custkey), 1, 16) AS author_hash, date_diff('day', o_orderdate::DATE, DATE '1999-01-01')::INT AS age_days FROM orders")
def git_blame(spark: SparkSession, sf: str) -> DataFrame:
    """The tool that takes a line's history, called by name with the columns of the detection."""
    rows = _table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderdate").alias("changed_at"), F.lit("1999-01-01").alias("scanned_at"))
    seen = tools.observation(F.lit("git_blame_check"), F.create_map().cast("map<string,string>"), set(rows.columns))
    out = rows.select("o_orderkey", F.from_json(seen, "author_hash string, age_days int").alias("x"))
    return out.select("o_orderkey", "x.author_hash", "x.age_days")

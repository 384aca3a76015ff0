"""Metrics of benchmark and evaluation rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivet.schema import STATUSES


def ratio(num: Column, den: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _counts(true: Column, pred: Column) -> list[Column]:
    at = lambda t, p: F.count_if((true == t) & (pred == p))
    return [at(1, 1).alias("tp"), at(0, 0).alias("tn"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), F.count(F.lit(1)).alias("n")]


def _scores(rows: DataFrame) -> DataFrame:
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    rows = rows.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("accuracy", ratio(tp + tn, n))
    p, r = F.col("precision"), F.col("recall")
    rows = rows.withColumn("f1", ratio(2 * p * r, p + r))
    return rows.withColumn("fpr", ratio(fp, fp + tn)).withColumn("fnr", ratio(fn, fn + tp)).withColumn("specificity", ratio(tn, tn + fp)).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def binary_metrics(rows: DataFrame, *by: str, true: str = "expected_binary", pred: str = "predicted_binary") -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, rates of error and balanced accuracy, for each group."""
    return _scores(rows.groupBy(*by).agg(*_counts(F.col(true), F.col(pred))))


def slice_metrics(rows: DataFrame, slice_col: str = "distractor_type") -> DataFrame:
    """:func:`binary_metrics` for each slice; null and empty slices are ``original``."""
    return binary_metrics(rows.withColumn("slice", F.coalesce(F.nullif(slice_col, F.lit("")), F.lit("original"))), "slice")


def dimension_slices(rows: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """``dimension, value`` and binary metrics along several dimensions in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("d"), v.cast("string").alias("v")) for k, v in dims.items()])
    return binary_metrics(rows.withColumn("_x", F.explode(pairs)).withColumn("dimension", F.col("_x.d")).withColumn("value", F.col("_x.v")), "dimension", "value")


def entropy_bucket(e: Column) -> Column:
    return F.when(e < 2, "<2").when(e < 3, "2-3").when(e < 4, "3-4").otherwise(">=4")


def confusion(rows: DataFrame, true: str = "expected_status", pred: str = "predicted_status") -> DataFrame:
    return rows.groupBy(true, pred).count()


def multiclass_metrics(rows: DataFrame, true: str = "expected_status", pred: str = "predicted_status") -> DataFrame:
    """``label, support, precision, recall, f1, macro_f1, accuracy``, a row for each label, also for labels without rows.
    Rows of unknown labels count in accuracy and as errors of no class."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.explode(F.array(*map(F.lit, STATUSES)))
    per_cell = cells.select("*", labels.alias("label"))
    t, p, lab, n = F.col("t"), F.col("p"), F.col("label"), F.col("n")
    sums = per_cell.groupBy("label").agg(
        F.sum(F.when((t == lab) & (p == lab), n).otherwise(0)).alias("tp"),
        F.sum(F.when((t != lab) & (p == lab) & t.isin(*STATUSES), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == lab) & (p != lab) & p.isin(*STATUSES), n).otherwise(0)).alias("fn"),
        F.sum(F.when(t == lab, n).otherwise(0)).alias("support"),
        F.sum(F.when(t == p, n).otherwise(0)).alias("hits"),
        F.sum(n).alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = sums.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    every = Window.partitionBy(F.lit(1))  # as many rows as there are labels
    return out.select("label", "support", "precision", "recall", "f1", (F.sum("f1").over(every) / len(STATUSES)).alias("macro_f1"), ratio(F.col("hits"), F.col("n")).alias("accuracy"))


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """``by..., percent, value``: the value at index ``round_half_even(percent / 100 * (n - 1))`` of the sorted values.

    No group is sorted as a whole: approximate cut points part each group, counts tell which part holds an index, and
    within the parts only distinct values with their counts are put in order.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    data = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    cuts = data.groupBy(*by).agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]

    def attach(left: DataFrame, right: DataFrame, extra: list[Column]) -> DataFrame:
        if not by:
            return left.crossJoin(F.broadcast(right))  # one row
        on = same[0]
        for s in same[1:]:
            on = on & s
        drop = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in by]
        return left.alias("l").join(right.alias("r"), on if not extra else on & extra[0]).select(*drop)

    counted = data.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    parted = attach(counted, cuts, []).withColumn("part", F.size(F.filter("cuts", lambda t: t < F.col("x"))))
    sizes = parted.groupBy(*by, "part").agg(F.sum("c").alias("size"), F.first("n").alias("n"))
    before = F.sum("size").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # 64 rows a group
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = sizes.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"))
    index = F.least(F.col("n") - 1, F.bround(F.col("percent") / 100 * (F.col("n") - 1), 0).cast("long"))
    wanted = wanted.withColumn("index", index).filter((F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("size")))
    inner = parted.select(*keys, F.col("part").alias("own"), "x", "c")
    joined = attach(inner, wanted.select(*by, "part", "before", "percent", "index"), [F.col("l.own") == F.col("r.part")]) if by else inner.join(F.broadcast(wanted.select("part", "before", "percent", "index")), F.col("own") == F.col("part"))
    upto = F.sum("c").over(Window.partitionBy(*by, "percent").orderBy("x"))
    return joined.withColumn("upto", F.col("before") + upto).filter(F.col("upto") > F.col("index")).groupBy(*by, "percent").agg(F.min("x").alias("value"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """A row for each model and strategy: metrics, rates, latencies and confusion texts, in that order.

    ``hard_negative_recall`` is the literal recall of the hard-negative slice (0 where it has no positives, null without
    the slice); ``hard_negative_specificity`` is the recall of its class 0.
    """
    by = ["model", "strategy"]
    hard = F.col("distractor_type") == "hard_negative"
    t, p = F.col("expected_is_credentials"), F.col("predicted_is_credentials")
    base = rows.groupBy(*by).agg(
        *_counts(t, p),
        F.count_if(hard).alias("hard_n"),
        F.count_if(hard & (t == 1) & (p == 1)).alias("hard_tp"),
        F.count_if(hard & (t == 1)).alias("hard_p"),
        F.count_if(hard & (t == 0) & (p == 0)).alias("hard_tn"),
        F.avg(F.col("json_valid").cast("int")).alias("json_valid_rate"),
        F.avg(F.col("schema_valid").cast("int")).alias("schema_valid_rate"),
        F.avg("evidence_grounding").alias("evidence_grounding"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg((F.col("predicted_status") == "REVIEW").cast("int")).alias("review_rate"),
        F.avg(F.col("escalated").cast("int")).alias("escalation_rate"),
    )
    out = _scores(base)
    out = out.withColumn("hard_negative_recall", F.when(F.col("hard_n") > 0, ratio(F.col("hard_tp"), F.col("hard_p"))))
    out = out.withColumn("hard_negative_specificity", F.when(F.col("hard_n") > 0, ratio(F.col("hard_tn"), F.col("hard_n") - F.col("hard_p"))))
    late = nearest_rank(rows, by, "latency_ms", [50, 95, 99]).groupBy(*by).agg(*[F.max(F.when(F.col("percent") == q, F.col("value"))).alias(f"p{q}_latency_ms") for q in (50, 95, 99)])
    cells = rows.groupBy(*by, F.concat_ws("->", "expected_status", "predicted_status").alias("cell")).count()
    cells = cells.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell", "count"))))).alias("confusion"))  # a few cells
    drop = ("hard_n", "hard_tp", "hard_p", "hard_tn")
    return out.drop(*drop).join(late, by, "left").join(cells, by, "left").orderBy(*by)


def cost_multiplier(summary: DataFrame, baseline: str = "direct_json") -> DataFrame:
    """Average latency as a multiple of the model's baseline strategy."""
    base = summary.filter(F.col("strategy") == baseline).select("model", F.col("avg_latency_ms").alias("_b"))
    return summary.join(F.broadcast(base), "model", "left").withColumn("cost_multiplier", F.when(F.col("_b") > 0, F.col("avg_latency_ms") / F.col("_b"))).drop("_b")


#: Gates of promotion.
GATES = {"f1": 0.93, "hard_negative_specificity": 0.85, "json_valid_rate": 0.99, "schema_valid_rate": 0.98, "evidence_grounding": 0.90}


def promotion(summary: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """``failed_gates`` and ``rank`` of the cells that pass all: best F1 first, then the lowest latency."""
    failed = F.filter(F.array(*[F.when(~(F.coalesce(F.col(k), F.lit(0.0)) >= v), k) for k, v in gates.items()]), lambda x: x.isNotNull())
    out = summary.withColumn("failed_gates", failed)
    place = F.row_number().over(Window.partitionBy(F.size("failed_gates") == 0).orderBy(F.desc("f1"), "avg_latency_ms", "model", "strategy"))  # as many rows as cells
    return out.withColumn("rank", F.when(F.size("failed_gates") == 0, place))


def canary(current: DataFrame, candidate: DataFrame, metric: str = "f1", limit: float = 0.02) -> DataFrame:
    """Cells whose metric falls by more than ``limit``."""
    a = current.select("model", "strategy", F.col(metric).alias("before"))
    joined = a.join(candidate.select("model", "strategy", F.col(metric).alias("after")), ["model", "strategy"], "left")
    return joined.withColumn("blocked", (F.col("before") - F.coalesce("after", F.lit(0.0))) > limit)


def value_counts(rows: DataFrame, col: str, default: str | None = None) -> DataFrame:
    v = F.col(col).cast("string")
    return rows.groupBy((F.coalesce(F.nullif(v, F.lit("")), F.lit(default)) if default else v).alias("value")).count()


def escalation(routed: DataFrame) -> DataFrame:
    """Rows and shares of each route."""
    n = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # four routes


def tool_metrics(rows: DataFrame) -> DataFrame:
    """Calls a detection, the share of failed observations, and which tools ran."""
    calls = rows.select(F.explode("tool_calls").alias("c"))
    per_tool = calls.groupBy(F.col("c.tool").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.avg((~F.contains("c.observation", F.lit('"status":"ok"'))).cast("int")).alias("error_rate"))
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    return per_tool.join(F.broadcast(n)).select("tool", "calls", "error_rate", (F.col("calls") / F.col("rows")).alias("calls_per_detection"))


def asof_decisions(calls: DataFrame, decisions: DataFrame, key: str, time_col: str, id_col: str, width: str = "1 day") -> DataFrame:
    """``calls`` with ``before`` and ``after``: the status of the last decision up to a call's time, and of the first one later;
    null where there is none. ``decisions`` has key, time, id and ``status``; of decisions of one time the largest id is the last.

    Rows are put in order inside ``width`` of a key's time only; what stands at the borders comes from the key's other stretches, a
    row for each. So a key of very many rows is many tasks.
    """
    columns = [c for c in calls.columns if c not in (key, time_col, id_col)]
    row = lambda rows, is_call: rows.select(key, time_col, id_col, F.lit(is_call).alias("_call"), (F.lit(None).cast("string") if is_call else F.col("status")).alias("_status"), (F.struct(*columns) if is_call else F.lit(None).cast(calls.select(F.struct(*columns)).schema[0].dataType)).alias("_row"))
    both = row(calls, True).unionByName(row(decisions.filter("status IS NOT NULL"), False))
    both = both.withColumn("_stretch", F.window(F.col(time_col).cast("timestamp"), width)["start"])
    place = F.struct(time_col, "_call", id_col)
    inside = Window.partitionBy(key, "_stretch").orderBy(time_col, "_call", id_col)
    near = both.withColumns({
        "_before": F.last("_status", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("_status", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("_call")
    ends = both.groupBy(key, "_stretch").agg(F.min_by("_status", F.when(F.col("_status").isNotNull(), place)).alias("_first"), F.max_by("_status", F.when(F.col("_status").isNotNull(), place)).alias("_last"))
    along = Window.partitionBy(key).orderBy("_stretch")
    ends = ends.select(
        F.col(key).alias("_key"), F.col("_stretch").alias("_at"),
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    joined = near.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_stretch").eqNullSafe(F.col("_at")))
    return joined.select(key, time_col, id_col, "_row.*", F.coalesce("_before", "_earlier").alias("before"), F.coalesce("_after", "_later").alias("after"))


def tool_effects(calls: DataFrame) -> DataFrame:
    """For each tool, from calls with ``before`` and ``after`` (:func:`asof_decisions`): calls, mean latency, the share of decisions that
    changed, and the share of REVIEW that was resolved; calls without a decision on either side count in neither share."""
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(F.when(both, (F.col("before") != F.col("after")).cast("int"))).alias("changed_rate"),
        F.avg(F.when(both & (F.col("before") == "REVIEW"), (F.col("after") != "REVIEW").cast("int"))).alias("review_resolved_rate"),
    )


def length_bucket(n: Column) -> Column:
    return F.when(n < 8, "<8").when(n < 16, "8-15").when(n < 32, "16-31").when(n < 64, "32-63").otherwise(">=64")


#: Wordings that tell a model what to do; a context that holds one is of the injection slice.
INJECTIONS = r"(?i)ignore (?:all|any|the|previous|prior|above)|disregard (?:all|any|the|previous|prior)|you are now|system prompt|act as (?:an?|the) |mark (?:this|it) as (?:safe|false)|answer only with"


def injected(context: Column) -> Column:
    return F.coalesce(context.rlike(INJECTIONS), F.lit(False))


def injection_resistance(rows: DataFrame) -> DataFrame:
    """For each model and strategy: rows of the injection slice, the share of them that is answered as expected, and the
    same share outside the slice."""
    hit, right = injected(F.col("context")), (F.col("expected_status") == F.col("predicted_status")).cast("int")
    return rows.groupBy("model", "strategy").agg(F.count_if(hit).alias("injected"), F.avg(F.when(hit, right)).alias("resistance"), F.avg(F.when(~hit, right)).alias("others"))


def disagreements(rows: DataFrame) -> DataFrame:
    """``record_id, statuses, disagree``: whether models or strategies give a record different statuses."""
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_set("predicted_status")).alias("statuses")).withColumn("disagree", F.size("statuses") > 1)


def answer_rates(rows: DataFrame, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each model and strategy, from ``prompt, raw_response``: shares of answers that had to be cut out of other text
    (repaired), of answers without any object, which become REVIEW (fallback), and mean words of prompts and answers; with
    ``tokens`` (:func:`trivet.functions.tokens.counter`) also their mean tokens."""
    from trivet.functions import jsonx, text as T

    kind = T.let(jsonx.json_object(F.col("raw_response")), lambda o: F.when(o.isNull(), "fallback").when(T.strip(F.col("raw_response")) != T.strip(o), "repaired").otherwise("whole"))
    words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    counted = {"_prompt_tokens": tokens(F.col("prompt")), "_answer_tokens": tokens(F.col("raw_response"))} if tokens else {}
    out = rows.withColumns({"_kind": kind} | counted).groupBy("model", "strategy")
    share = lambda k: F.avg((F.col("_kind") == k).cast("int")).alias(f"{k}_rate")
    more = [F.avg("_prompt_tokens").alias("prompt_tokens"), F.avg("_answer_tokens").alias("answer_tokens")] if tokens else []
    return out.agg(share("repaired"), share("fallback"), F.avg(words("prompt")).alias("prompt_words"), F.avg(words("raw_response")).alias("answer_words"), *more)


def histogram(rows: DataFrame, col: str, bounds: Sequence[float], *by: str) -> DataFrame:
    """``le, n``: rows up to each bound, counted cumulatively; the last bound is infinite. Nulls count nowhere."""
    ends = [*bounds, float("inf")]
    counts = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.count_if(F.col(col) <= e).alias("n")) for e in ends])
    return rows.filter(F.col(col).isNotNull()).groupBy(*by).agg(counts.alias("h")).select(*by, F.explode("h").alias("x")).select(*by, "x.le", "x.n")


def review_queue(decided: DataFrame, cluster_col: str) -> DataFrame:
    """Detections that people must look at, with a ``priority``: how many open ones their cluster has, then how uncertain
    the decision is. Cluster sizes are aggregated and joined back."""
    open_ = decided.filter((F.col("status") == "REVIEW") | ~F.col("json_valid"))
    sizes = open_.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("cluster_size"))
    return open_.join(sizes, cluster_col).withColumn("priority", F.col("cluster_size") + (1 - F.abs(F.col("confidence") - 0.5) * 2))

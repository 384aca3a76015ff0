"""Decisions for detections: a cheap filter first, a model for the rest, strategies around the model.

A provider is a function ``(df, model, temperature) -> df`` that adds ``raw_response`` (text, null for a failed call) to
rows with ``prompt`` and ``system``; a row whose prompt is null is not asked. :func:`native_provider` answers in the JVM; :func:`callable_provider` calls any
Python function in batches.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from trivet.functions import jsonx, tools
from trivet.functions import text as T
from trivet.operators.clusters import written

Provider = Callable[[DataFrame, str, float], DataFrame]
PREFILTER_ENTROPY = 2.5
LOWER, UPPER = 0.4, 0.6
STRATEGIES = ("direct_json", "few_shot", "cot_distilled", "tool_assisted", "self_consistency", "react_triage")
SYSTEM = (
    "You decide whether a detected value is a live credential. Answer with one JSON object with the fields is_credentials (0 or 1), "
    "status (REAL, FALSE_POSITIVE or REVIEW), confidence (0 to 1), reasoning, evidence (a list of short texts) and agent_trace."
)
REACT_SYSTEM = SYSTEM + " Instead of an answer you may ask for one tool: {\"action\": name, \"args\": {...}}; end with {\"final\": answer}. Tools: " + ", ".join(sorted(tools.REGISTRY)) + "."
#: Terms and rules of the deterministic responder.
RESPONDER_PLACEHOLDERS = ("test", "example", "placeholder", "your_", "replace", "demo", "sample", "xxx", "changeme", "password123", "none", "null")
RESPONDER_RESETS = ("reset", "recover", "policy", "expired", "password help", "password update")
SHOTS = (
    ("File: deploy/prod.env | Source: scanner\nPattern: PASSWORD | Match: Kestrel7!mooring\nContext:\nDB_USER=svc\nDB_PASS=Kestrel7!mooring", "REAL", 0.96, "assigned to a password key"),
    ("File: README.md | Source: scanner\nPattern: API_KEY | Match: YOUR_KEY\nContext:\nput YOUR_KEY here", "FALSE_POSITIVE", 0.98, "placeholder in documentation"),
    ("File: ops/notes.txt | Source: scanner\nPattern: PASSWORD | Match: 7f3c9a02d1\nContext:\nlast value seen was 7f3c9a02d1, owner unknown", "REVIEW", 0.5, "neither use nor format is clear"),
    ("File: web/help.html | Source: scanner\nPattern: PASSWORD | Match: renew-4471\nContext:\nto renew your password open ticket renew-4471", "FALSE_POSITIVE", 0.95, "ticket in a help text"),
)


def responder(prompt: Column) -> Column:
    """JSON answer of fixed rules to a prompt; null to a null one."""
    answer = T.let(prompt, lambda p: T.let(T.strip(F.coalesce(T.prompt_field(p, "matched_value"), F.lit(""))), lambda v: T.let(F.lower(p), lambda low: _response(v, low))))
    return F.when(prompt.isNotNull(), answer)


def _response(value: Column, low: Column) -> Column:
    low_value = F.lower(value)
    harmless = low_value.rlike("|".join(RESPONDER_PLACEHOLDERS)) | low.rlike("|".join(RESPONDER_RESETS))
    dashes = F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit("")))
    likely = ((F.length(value) > 20) & value.rlike("[!@#$%^&*]")) | F.contains(low, F.lit("bearer ")) | value.startswith("AKIA") | ((dashes >= 4) & (F.length(value) > 30))
    answer = lambda flag, status, conf, why, what: F.to_json(
        F.struct(
            F.lit(flag).alias("is_credentials"), F.lit(status).alias("status"), F.lit(conf).alias("confidence"), F.lit(why).alias("reasoning"), F.array(F.lit(what)).alias("evidence"),
            F.struct(F.lit("test_mode").alias("strategy"), F.array().cast("array<string>").alias("checks"), F.array().cast("array<string>").alias("tool_calls")).alias("agent_trace"),
        )
    )
    return (
        F.when(harmless, answer(0, "FALSE_POSITIVE", 0.9, "Placeholder or reset wording.", "placeholder_or_reset_context"))
        .when(likely, answer(1, "REAL", 0.85, "Shaped like a credential.", "credential_format"))
        .otherwise(answer(0, "REVIEW", 0.6, "Not certain.", "ambiguous"))
    )


def native_provider(df: DataFrame, model: str, temperature: float) -> DataFrame:
    """The responder on the base prompt, whatever a strategy added to it."""
    return df.withColumn("raw_response", responder(F.col("base_prompt") if "base_prompt" in df.columns else F.col("prompt")))


def has_object(text: str | None) -> bool:
    """Whether a JSON object begins anywhere in the text."""
    at = -1
    while text and (at := text.find("{", at + 1)) >= 0:
        try:
            json.JSONDecoder().raw_decode(text, at)
            return True
        except ValueError:
            continue
    return False


def http_model(url: str, timeout: float = 60.0, token: str | None = None) -> Callable[[str, str, str, float], str]:
    """A function for :func:`callable_provider` that posts chat messages to an endpoint of the common chat form and returns
    the answer's text. A call that takes longer than ``timeout`` seconds fails."""

    def ask_model(prompt: str, system: str, model: str, temperature: float) -> str:
        body = {"model": model, "temperature": temperature, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            got = json.load(answer)
        return (got["choices"][0]["message"] if "choices" in got else got["message"])["content"]

    return ask_model


def called(fn: Callable[[Any], Any], items: Iterable[Any], at_once: int, deadline: float | None = None) -> Iterator[tuple[int, Any, float]]:
    """``place, fn(item), milliseconds`` for every item as answers come, with ``at_once`` calls in flight at most. A call that fails,
    or has run ``deadline`` seconds, gives None; the one that runs on is left to itself."""
    done: queue.Queue = queue.Queue()
    begun: dict[int, float] = {}
    ms = lambda i: (time.perf_counter() - begun.pop(i)) * 1000

    def work(i: int, item: Any) -> None:
        try:
            done.put((i, fn(item)))
        except Exception:  # noqa: BLE001  any failure of a remote model is no answer
            done.put((i, None))

    items, more = iter(enumerate(items)), True
    while more or begun:
        while more and len(begun) < at_once:
            try:
                i, item = next(items)
            except StopIteration:
                more = False
                break
            begun[i] = time.perf_counter()
            threading.Thread(target=work, args=(i, item), daemon=True).start()
        if not begun:
            return
        try:
            i, answer = done.get(timeout=None if deadline is None else max(0.0, min(begun.values()) + deadline - time.perf_counter()))
            if i in begun:  # else it has been given up
                yield i, answer, ms(i)
        except queue.Empty:
            now = time.perf_counter()
            for i in [i for i, t in begun.items() if now - t >= deadline]:
                yield i, None, ms(i)


def callable_provider(fn: Callable[[str, str, str, float], str], retries: int = 1, at_once: int = 8, deadline: float | None = None) -> Provider:
    """Calls ``fn(prompt, system, model, temperature)`` once for every distinct prompt (and sample, in strategies that draw several), and
    again, ``retries`` times at most, where the call fails or its answer holds no JSON object; the last answer counts, null after a
    failure, so the decision is REVIEW. Adds ``raw_response`` and ``latency_ms``.

    Prompts are brought together by digest and dealt over all cores; each task has ``at_once`` calls in flight and gives one up
    after ``deadline`` seconds. Answers are written before they are joined back, so no later stage repeats a call; a task that Spark runs
    again does, so calls must be repeatable. On a stream rows are asked as they come."""

    def provide(df: DataFrame, model: str, temperature: float) -> DataFrame:
        def call(ask: tuple[str | None, str]) -> str | None:
            answer = None
            for left in range(retries, -1, -1):
                try:
                    answer = fn(*ask, model, temperature)
                except Exception:  # noqa: BLE001
                    if not left:
                        return answer
                    continue
                if has_object(answer):
                    break
            return answer

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                asked = batch["prompt"].notna().to_numpy()
                places = asked.nonzero()[0]
                texts, took = [None] * len(batch), [None] * len(batch)
                for i, answer, ms in called(call, zip(batch["prompt"][asked], batch["system"][asked]), at_once, deadline):
                    texts[places[i]], took[places[i]] = answer, ms
                yield batch.assign(raw_response=pd.Series(texts, batch.index, object), latency_ms=pd.Series(took, batch.index, float))

        if df.isStreaming:
            return df.mapInPandas(run, StructType([*df.schema.fields]).add("raw_response", StringType()).add("latency_ms", DoubleType()))
        key = ["system", "prompt", *(["sample"] if "sample" in df.columns else [])]
        rows = df.withColumn("_ask", F.when(F.col("prompt").isNotNull(), F.sha2(F.to_json(F.struct(*key)), 256)))
        asks = rows.filter("_ask IS NOT NULL").groupBy("_ask").agg(F.first("prompt").alias("prompt"), F.first("system").alias("system"))
        asks = asks.repartition(df.sparkSession.sparkContext.defaultParallelism, "_ask")
        answers = written(asks.mapInPandas(run, "_ask string, prompt string, system string, raw_response string, latency_ms double").select("_ask", "raw_response", "latency_ms"))
        return rows.join(answers, "_ask", "left").drop("_ask")

    return provide


def _prompted(detections: DataFrame, strategy: str, wanted: Column | None = None) -> DataFrame:
    base = T.prompt(*[F.col(c) for c in ("file_path", "source", "pattern_name", "matched_value", "context")])
    base = base if wanted is None else F.when(wanted, base)
    suffix = {
        "few_shot": F.lit("\n\nAnswer as in the examples, with the JSON object only."),
        "cot_distilled": F.lit("\n\nGive short reasons and evidence; no hidden reasoning."),
        "react_triage": F.lit("\n\nOne JSON object a turn: a tool call or the final answer."),
    }.get(strategy, F.lit(""))
    if strategy == "tool_assisted":
        suffix = F.concat(F.lit("\n\nTool results:\n"), tools.basic_tools(F.col("matched_value"), F.col("context"), F.col("file_path")))
    return detections.withColumn("base_prompt", base).withColumn("prompt", F.concat("base_prompt", suffix)).withColumn("system", F.lit(REACT_SYSTEM if strategy == "react_triage" else SYSTEM))


def messages(prompt: Column) -> Column:
    """Chat messages: system text, examples, the prompt."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = [x for q, status, conf, why in SHOTS for x in (m("user", F.lit(q)), m("assistant", F.to_json(F.struct(F.lit(int(status == "REAL")).alias("is_credentials"), F.lit(status).alias("status"), F.lit(conf).alias("confidence"), F.lit(why).alias("reasoning")))))]
    return F.array(m("system", F.lit(SYSTEM)), *shots, m("user", prompt))


def _decided(df: DataFrame, strategy: str, model: str) -> DataFrame:
    return df.withColumn("decision", jsonx.decision(jsonx.json_object(F.col("raw_response")), F.lit(strategy), F.lit(model)))


def ask(detections: DataFrame, provider: Provider, strategy: str = "direct_json", model: str = "native", temperature: float = 0.0) -> DataFrame:
    """One call a row; adds ``decision`` and ``raw_response``."""
    rows = provider(_prompted(detections, strategy), model, temperature)
    return _decided(rows, strategy, model).drop("base_prompt", "prompt", "system")


def low_entropy_decision() -> Column:
    """The decision for values of low entropy, of the fields of :func:`trivet.functions.jsonx.decision`."""
    return F.struct(
        F.lit(0).alias("is_credentials"), F.lit("FALSE_POSITIVE").alias("status"), F.lit(0.95).alias("confidence"), F.lit("Low entropy: likely a placeholder.").alias("reasoning"),
        F.array(F.lit(f"entropy < {PREFILTER_ENTROPY}")).alias("evidence"),
        F.struct(F.lit("deterministic_prefilter").alias("strategy"), F.array(F.lit("entropy")).alias("checks"), F.lit("prefilter").alias("model")).alias("agent_trace"),
        F.lit(True).alias("json_valid"), F.lit(False).alias("label_conflict"),
    )


def classify(detections: DataFrame, provider: Provider = native_provider, model: str = "native") -> DataFrame:
    """Every detection with ``decision``, ``raw_response`` and ``skipped_model``, in one pass; null and empty values have
    entropy 0. Rows that the entropy settles have a null prompt, so no provider is asked about them."""
    rows = detections.withColumn("skipped_model", T.let(F.col("matched_value"), T.entropy) < PREFILTER_ENTROPY)
    asked = provider(_prompted(rows, "direct_json", ~F.col("skipped_model")), model, 0.0).drop("base_prompt", "prompt", "system")
    decided = jsonx.decision(jsonx.json_object(F.col("raw_response")), F.lit("direct_json"), F.lit(model))
    return asked.withColumn("decision", F.when(F.col("skipped_model"), low_entropy_decision()).otherwise(decided))


def flat(decided: DataFrame) -> DataFrame:
    """Decision fields as columns."""
    return decided.select("*", *[F.col(f"decision.{c}").alias(c) for c in ("is_credentials", "status", "confidence", "reasoning", "evidence", "json_valid")]).drop("decision")


def _waited(rows: DataFrame) -> Column:
    """What a provider says that its call took, or null."""
    return F.col("latency_ms") if "latency_ms" in rows.columns else F.lit(None).cast("double")


def self_consistency(detections: DataFrame, id_col: str, provider: Provider = native_provider, model: str = "native", samples: int = 5, temperature: float = 0.3) -> DataFrame:
    """One greedy call; rows of REVIEW or middling confidence get more samples and a majority vote.

    A tie between statuses goes to the one of higher mean confidence, then to REVIEW. ``escalated``, ``votes_real``,
    ``sample_statuses`` and ``latency_ms`` (of all calls) tell what happened. Ids tell rows apart and are not null: answers are
    written and voted on by id, and texts are joined back once. Samples of a row are few by construction.
    """
    asked = ask(detections, provider, "self_consistency", model)
    first = written(asked.select(id_col, "decision", _waited(asked).alias("waited")))  # both ways read it; no call is made twice
    gate = F.coalesce((F.col("decision.status") == "REVIEW") | F.col("decision.confidence").between(LOWER, UPPER), F.lit(False))
    again = detections.join(first.filter(gate).select(id_col), id_col, "left_semi")
    again = again.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples - 1))))
    more = ask(again, provider, "self_consistency", model, temperature)
    more = written(more.select(id_col, "sample", "decision", _waited(more).alias("waited")))
    every = first.filter(gate).select(id_col, F.lit(0).alias("sample"), "decision", "waited").unionByName(more)
    s = F.col("decision.status")
    of = lambda name: F.struct(F.count_if(s == name).alias("n"), F.coalesce(F.avg(F.when(s == name, F.col("decision.confidence"))), F.lit(0.0)).alias("c"), F.lit(int(name == "REVIEW")).alias("r"), F.lit(name).alias("status"))
    voted = every.groupBy(id_col).agg(
        F.sum("decision.is_credentials").alias("votes_real"),
        F.avg("decision.confidence").alias("mean"),
        F.greatest(of("FALSE_POSITIVE"), of("REVIEW")).alias("other"),
        F.transform(F.sort_array(F.collect_list(F.struct("sample", s.alias("s")))), lambda x: x["s"]).alias("sample_statuses"),
        F.bool_and("decision.json_valid").alias("ok"),
        F.sum("waited").alias("latency_ms"),
    )
    real = F.col("votes_real") > samples / 2
    d = F.struct(
        F.when(real, 1).otherwise(0).alias("is_credentials"), F.when(real, "REAL").when(F.col("other.n") > 0, F.col("other.status")).otherwise("FALSE_POSITIVE").alias("status"),
        F.col("mean").alias("confidence"), F.lit("Majority of repeated samples.").alias("reasoning"), F.array(F.lit("self-consistency majority vote")).alias("evidence"),
        F.struct(F.lit("self_consistency").alias("strategy"), F.array().cast("array<string>").alias("checks"), F.lit(model).alias("model")).alias("agent_trace"),
        F.col("ok").alias("json_valid"), F.lit(False).alias("label_conflict"),
    )
    told = voted.select(id_col, d.alias("decision"), F.lit(True).alias("escalated"), "votes_real", "sample_statuses", "latency_ms")
    settled = first.filter(~gate).select(id_col, "decision", F.lit(False).alias("escalated"), F.lit(None).cast("long").alias("votes_real"), F.array("decision.status").alias("sample_statuses"), F.col("waited").alias("latency_ms"))
    return detections.join(settled.unionByName(told), id_col)


def policy_provider(df: DataFrame, model: str, temperature: float) -> DataFrame:
    """A deterministic policy for the tool loop: ask for the placeholder check, then for the context, then answer."""
    n = F.size("tool_calls")
    ask_for = lambda name: F.to_json(F.struct(F.lit(name).alias("action"), F.create_map().cast("map<string,string>").alias("args")))
    final = F.concat(F.lit('{"final": '), responder(F.col("base_prompt")), F.lit("}"))
    harmless = F.exists("tool_calls", lambda t: F.contains(t["observation"], F.lit('"is_placeholder":true')))
    return df.withColumn("raw_response", F.when(n == 0, ask_for("placeholder_check")).when((n == 1) & ~harmless, ask_for("context_signal_check")).otherwise(final))


def react(detections: DataFrame, provider: Provider = policy_provider, fallback: Provider = native_provider, model: str = "native", max_steps: int = 3) -> DataFrame:
    """A bounded loop of tool calls. Each step sees only the rows that are still open, and is written once; rows without a final
    answer after ``max_steps``, or with an answer that is neither tool nor final, get a direct call. Adds ``decision, tool_calls,
    steps, terminated, latency_ms`` (of all calls)."""
    names = detections.columns
    state = ["tool_calls", "steps", "waited"]
    active = detections.withColumns({"tool_calls": F.array().cast("array<struct<tool:string,args:map<string,string>,observation:string>>"), "steps": F.lit(0), "waited": F.lit(None).cast("double")})
    done: list[DataFrame] = []
    rest: list[DataFrame] = []
    for step in range(max_steps):
        so_far = F.when(F.size("tool_calls") > 0, F.concat(F.lit("\n\nSo far:\n"), F.to_json("tool_calls"))).otherwise("")
        asked = provider(_prompted(active, "react_triage").withColumn("prompt", F.concat("prompt", so_far)), model, 0.0)
        waited = F.coalesce(F.col("waited") + _waited(asked), _waited(asked), F.col("waited"))
        turn = F.from_json(jsonx.json_object(F.col("raw_response")), "final string, action string, args map<string,string>")
        asked = asked.withColumns({"waited": waited, "turn": turn, "steps": F.lit(step + 1)})
        ended = F.coalesce(F.col("turn.final").startswith("{"), F.lit(False))
        args = F.coalesce("turn.args", F.create_map().cast("map<string,string>"))
        asked = asked.withColumn("ended", ended).withColumn("args", args)
        asked = asked.withColumn("seen", F.when(~F.col("ended"), tools.observation(F.col("turn.action"), F.col("args"), set(names))))
        asked = written(asked.select(*names, *state, "ended", "seen", "args", F.when(F.col("ended"), F.col("turn.final")).alias("final"), F.col("turn.action").alias("action")))  # no call is made twice
        final = asked.filter("ended")
        done.append(final.select(*names, jsonx.decision(F.col("final"), F.lit("react_triage"), F.lit(model)).alias("decision"), *state, F.lit("final").alias("terminated")))
        call = F.struct(F.col("action").alias("tool"), F.col("args").alias("args"), F.col("seen").alias("observation"))
        rest.append(asked.filter("NOT ended AND seen IS NULL").select(*names, *state))
        active = asked.filter("NOT ended AND seen IS NOT NULL").select(*names, F.array_append("tool_calls", call).alias("tool_calls"), "steps", "waited")
    asked = ask(reduce(DataFrame.unionByName, [active, *rest]), fallback, "direct_json", model)
    waited = F.coalesce(F.col("waited") + _waited(asked), _waited(asked), F.col("waited")).alias("waited")
    forced = asked.select(*names, "decision", "tool_calls", "steps", waited, F.lit("fallback_direct_json").alias("terminated"))
    return reduce(DataFrame.unionByName, [forced, *done]).withColumnRenamed("waited", "latency_ms")


def similar_examples(detections: DataFrame, pool: DataFrame, id_col: str, k: int = 2, most: int = 10_000) -> DataFrame:
    """``id, examples array<struct<example_id,score>>``: the ``k`` labelled examples (``example_id, context``) that share
    the largest part of their words with each detection's context, ties to the smaller id. The pool is a chosen set of
    ``most`` examples at most; a larger one is an error (:func:`trivet.operators.similar.most_similar` takes a pool of any size, by
    vectors). Words of four letters or more count; Spark broadcasts the pool's words only where it knows them to be few."""
    if pool.limit(most + 1).count() > most:
        raise ValueError(f"a pool of more than {most} examples")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("context", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    mine = detections.select(F.col(id_col).alias("id"), words.alias("ws"))
    theirs = pool.select("example_id", words.alias("es"))
    hits = mine.select("id", F.size("ws").alias("n"), F.explode("ws").alias("w")).join(theirs.select("example_id", F.size("es").alias("m"), F.explode("es").alias("w")), "w")
    scored = hits.groupBy("id", "example_id", "n", "m").agg(F.count(F.lit(1)).alias("c")).withColumn("score", F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "example_id")))  # of the pool at most
    top = scored.groupBy("id").agg(F.transform(F.slice(best, 1, k), lambda x: F.struct(x["example_id"].alias("example_id"), (-x["s"]).alias("score"))).alias("examples"))
    none = F.array().cast("array<struct<example_id:string,score:double>>")
    return mine.select("id").join(top.withColumn("examples", F.col("examples").cast("array<struct<example_id:string,score:double>>")), "id", "left").withColumn("examples", F.coalesce("examples", none))


def best_hypothesis(hypotheses: DataFrame, id_col: str, score_col: str) -> DataFrame:
    """The hypothesis of the highest score for each id; ties go to the first text by order."""
    cols = [c for c in hypotheses.columns if c != id_col]
    return hypotheses.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.struct(F.col(score_col), F.struct(*[F.col(c).cast("string") for c in cols]))).alias("r")).select(id_col, "r.*")


def route(decided: DataFrame, accept: float = 0.85) -> DataFrame:
    """``route``: accept, self_consistency, react or analyst, by confidence, status and value entropy."""
    c, s = F.col("confidence"), F.col("status")
    r = F.when(~F.col("json_valid"), "analyst").when((s == "REVIEW") & (c < LOWER), "analyst").when((s == "REVIEW") | c.between(LOWER, UPPER), "self_consistency").when(c < accept, "react").otherwise("accept")
    return decided.withColumn("route", r)

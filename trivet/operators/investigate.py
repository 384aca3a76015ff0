"""Hypotheses about findings that nothing else settles: a beam search over them, scored by grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.functions import jsonx
from trivet.operators import triage
from trivet.operators.clusters import written

#: Hypotheses in order and the status that each stands for.
HYPOTHESES = {"REAL": "REAL", "FALSE_POSITIVE": "FALSE_POSITIVE", "TEST_ONLY": "FALSE_POSITIVE", "ROTATED": "REVIEW", "DOCUMENTATION_EXAMPLE": "FALSE_POSITIVE"}
#: Words that speak for a hypothesis, for the provider without a model.
SIGNS = {
    "REAL": ("prod", "login", "export"),
    "FALSE_POSITIVE": ("placeholder", "dummy", "none"),
    "TEST_ONLY": ("test", "mock", "fixture"),
    "ROTATED": ("rotated", "expired", "revoked"),
    "DOCUMENTATION_EXAMPLE": ("example", "readme", "docs"),
}
PATH = "array<struct<hypothesis:string,score:double>>"


def signs_provider(df: DataFrame, model: str, temperature: float) -> DataFrame:
    """Answers in the JVM: the evidence for a hypothesis is its signs, whatever the finding."""
    evidence = F.create_map(*[x for h, words in SIGNS.items() for x in (F.lit(h), F.array(*map(F.lit, words)))])
    answer = F.to_json(F.struct(F.element_at("path", F.size("path"))["hypothesis"].alias("reasoning"), evidence[F.element_at("path", F.size("path"))["hypothesis"]].alias("evidence")))
    return df.withColumn("raw_response", answer)


def _grounding(context: Column) -> Column:
    found = jsonx.text_list(jsonx.raw_fields(jsonx.json_object(F.col("raw_response")))["evidence"])
    return F.coalesce(jsonx.grounding_score(found, context, strict=True), F.lit(0.0))


def investigate(detections: DataFrame, id_col: str, provider: triage.Provider = signs_provider, model: str = "native", beam: int = 2, rounds: int = 2) -> DataFrame:
    """``id, hypothesis, status, score, path array<struct<hypothesis, score>>`` for every detection.

    In each round every path that is left is extended by each hypothesis that it does not hold; a path's score is the mean grounding
    of the evidence that the provider gives for its hypotheses. The ``beam`` best paths of a detection go on, ties by the scores of
    earlier hypotheses, then by the order of :data:`HYPOTHESES`. The answer is the first hypothesis of the best path.

    Ids tell detections apart and are not null. A round's answers are written by id and path, so calls are not repeated and texts are
    not written; a provider of :func:`trivet.operators.triage.callable_provider` asks each distinct hypothesis once. A detection has
    ``beam`` times five paths in a round at most, so keeping the best is an aggregation of bounded lists; they meet the texts again
    as one row a detection, and are dealt out by id on both sides, never broadcast.
    """
    rank = F.create_map(*[x for i, h in enumerate(HYPOTHESES) for x in (F.lit(h), F.lit(i))])
    base = triage._prompted(detections, "direct_json").withColumn("system", F.lit(triage.SYSTEM))
    held = base.withColumn("_beam", F.array(F.array().cast(PATH)))
    for _ in range(rounds):
        step = lambda h: F.struct(h.alias("hypothesis"), F.lit(None).cast("double").alias("score"))
        free = lambda path: F.filter(F.array(*map(F.lit, HYPOTHESES)), lambda h: ~F.exists(path, lambda p: p["hypothesis"] == h))
        longer = F.flatten(F.transform("_beam", lambda path: F.transform(free(path), lambda h: F.array_append(path, step(h)).cast(PATH))))
        text = jsonx.grounding_text(F.col("context"), F.col("matched_value"), F.col("file_path"))
        asked = held.withColumn("_text", text).withColumn("path", F.explode(longer)).drop("_beam")
        names = F.array_join(F.transform("path", lambda p: p["hypothesis"]), " > ")
        asked = asked.withColumn("prompt", F.concat("prompt", F.lit("\n\nHypothesis: "), names, F.lit("\nGive the evidence for the last one.")))
        asked = provider(asked, model, 0.0)
        last = F.element_at("path", F.size("path"))["hypothesis"]
        scored = F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.struct(last.alias("hypothesis"), _grounding(F.col("_text")).alias("score"))))
        scored = written(asked.select(id_col, scored.cast(PATH).alias("path")))
        mean = F.aggregate("path", F.lit(0.0), lambda a, p: a + p["score"]) / F.size("path")
        entry = F.struct((-mean).alias("s"), F.transform("path", lambda p: -p["score"]).alias("t"), F.transform("path", lambda p: rank[p["hypothesis"]]).alias("r"), F.col("path").alias("path"))
        best = scored.groupBy(id_col).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, beam).alias("b"))
        # Paths are a few bytes each where they are written, so that Spark would take them for a table to broadcast.
        held = base.join(best.select(id_col, F.col("b.path").alias("_beam")).hint("merge"), id_col)
    top = best.select(id_col, F.get("b", 0).alias("b"))
    name = F.col("b.path")[0]["hypothesis"]
    status = F.create_map(*[F.lit(x) for kv in HYPOTHESES.items() for x in kv])
    return top.select(id_col, name.alias("hypothesis"), status[name].alias("status"), (-F.col("b.s")).alias("score"), "b.path")


def settle_disagreements(voted: DataFrame, id_col: str, provider: triage.Provider = signs_provider, model: str = "native") -> DataFrame:
    """Rows of :func:`trivet.operators.triage.self_consistency`, those whose samples disagree with the status that an investigation
    finds (``investigated``)."""
    unlike = F.size(F.array_distinct("sample_statuses")) > 1
    found = investigate(voted.filter(unlike), id_col, provider, model).select(id_col, F.col("status").alias("_status"))
    joined = voted.join(found.hint("merge"), id_col, "left")
    own = {"status": F.coalesce("_status", "decision.status"), "is_credentials": F.coalesce((F.col("_status") == "REAL").cast("int"), "decision.is_credentials")}
    decision = F.struct(*[own.get(c, F.col(f"decision.{c}")).alias(c) for c in voted.schema["decision"].dataType.names])
    return joined.withColumn("decision", decision).withColumn("investigated", F.col("_status").isNotNull()).drop("_status")

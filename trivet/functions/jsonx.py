"""Model text to decisions: tolerant JSON, the decision contract, grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivet.functions.text import is_real, let, normalize_status, strip
from trivet.schema import RAW_DECISION, STATUSES

REQUIRED = ("is_credentials", "status", "confidence", "reasoning", "evidence", "agent_trace")
#: Evidence that needs no support in the text.
GROUNDED_PREFIXES = ("source:", "distractor:", "near ", "high entropy", "low entropy", "no ", "placeholder", "documentation")


def _nested(depth: int) -> str:
    """Balanced braces; those inside quoted texts do not count."""
    quoted = r'"(?:[^"\\]++|\\.)*+"'
    inner = rf'\{{(?:[^{{}}"]++|{quoted})*+\}}'
    for _ in range(depth - 1):
        inner = rf'\{{(?:[^{{}}"]++|{quoted}|{inner})*+\}}'
    return "(?s)" + inner


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def json_object(text: Column, depth: int = 24) -> Column:
    """The whole text if it is a JSON object, else the first stretch of balanced braces that is one (of deeper braces than
    ``depth``, the text from the first to the last brace), else null. Arrays and scalars are no answer."""

    def found(t: Column) -> Column:
        parts = F.filter(F.regexp_extract_all(t, F.lit(_nested(depth)), F.lit(0)), _is_object)
        widest = F.filter(F.array(F.regexp_extract(t, r"(?s)\{.*\}", 0)), _is_object)
        return F.when(_is_object(t), t).otherwise(F.coalesce(F.get(parts, 0), F.get(widest, 0)))

    return let(text, found)


def raw_fields(obj: Column) -> Column:
    return F.from_json(obj, RAW_DECISION)


def truth(v: Column) -> Column:
    """1 or 0 for the ways to write a boolean, else null."""
    low = F.lower(v)
    return F.when(low.isin("1", "true", "1.0"), 1).when(low.isin("0", "false", "0.0"), 0)


def text_list(v: Column) -> Column:
    """An array from JSON text: its items, a bare text as one item, anything else nothing."""
    return (
        F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")))
        .when(v.isNull() | v.startswith("{") | v.rlike(r"^(?:-?[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false)$"), F.array().cast("array<string>"))
        .otherwise(F.array(v))
    )


def decision(obj: Column, strategy: Column, model: Column, checks: tuple[str, ...] = ()) -> Column:
    """The decision contract from an object's text; a null text gives the decision of a failed call.

    REVIEW with a positive flag becomes REAL; other conflicts of status and flag stay and are flagged.
    """
    return let(obj, lambda o: let(raw_fields(o), lambda raw: _decision(o.isNotNull(), raw, strategy, model, checks)))


def _decision(ok: Column, raw: Column, strategy: Column, model: Column, checks: tuple[str, ...]) -> Column:
    status = normalize_status(raw["status"])
    flag = F.coalesce(truth(raw["is_credentials"]), is_real(status))
    status = F.when((status == "REVIEW") & (flag == 1), "REAL").otherwise(status)
    confidence = F.coalesce(raw["confidence"].try_cast("double"), F.lit(0.5))
    evidence = F.when(raw["evidence"].isNotNull(), text_list(raw["evidence"])).otherwise(text_list(raw["indicators"]))
    given = F.from_json(raw["agent_trace"], "strategy string, checks array<string>, model string")
    return F.struct(
        F.when(ok, flag).otherwise(0).alias("is_credentials"),
        F.when(ok, status).otherwise("REVIEW").alias("status"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(0.5).alias("confidence"),
        F.when(ok, F.coalesce(F.nullif(raw["reasoning"], F.lit("")), F.lit("No reasoning provided."))).otherwise("The model gave no usable answer.").alias("reasoning"),
        F.when(ok, evidence).otherwise(F.array(F.lit("llm_error"))).alias("evidence"),
        F.struct(
            F.coalesce(given["strategy"], strategy).alias("strategy"),
            F.coalesce(given["checks"], F.array(*map(F.lit, checks)).cast("array<string>")).alias("checks"),
            F.coalesce(given["model"], model).alias("model"),
        ).alias("agent_trace"),
        ok.alias("json_valid"),
        (ok & (flag != is_real(status))).alias("label_conflict"),
    )


def schema_valid(obj: Column, exact_case: bool = True) -> Column:
    """Whether an object's text has all fields with values of the contract."""

    def valid(raw: Column) -> Column:
        status = raw["status"] if exact_case else F.upper(raw["status"])
        conf = raw["confidence"].try_cast("double")
        return status.isin(*STATUSES) & raw["evidence"].startswith("[") & raw["agent_trace"].startswith("{") & conf.between(0.0, 1.0) & truth(raw["is_credentials"]).isNotNull()

    have = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(F.json_object_keys(obj), F.array().cast("array<string>")))) == 0
    return F.coalesce(have & let(raw_fields(obj), valid), F.lit(False))


def extract_status(text: Column) -> Column:
    """The status of model text: of its JSON, else after ``"status":``, else the first label that occurs, else REVIEW."""
    return status_of(text, raw_fields(json_object(text))["status"])


def status_of(text: Column, parsed: Column) -> Column:
    """:func:`extract_status` of a text whose JSON has been parsed: ``parsed`` is the status there."""
    parsed = F.upper(parsed)
    quoted = F.regexp_extract(text, r'"status"\s*:\s*"([A-Z_]+)"', 1)
    up = F.upper(text)
    out = F.when(parsed.isin(*STATUSES), parsed).when(quoted.isin(*STATUSES), quoted)
    for label in STATUSES:
        out = out.when(F.contains(up, F.lit(label)), label)
    return out.otherwise("REVIEW")


def grounding_text(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def grounding_score(evidence: Column, text: Column, strict: bool = False) -> Column:
    """The share of evidence items with a known prefix (not if ``strict``) or a word of three letters that is in ``text``."""

    def grounded(item: Column) -> Column:
        s = strip(F.lower(item))
        known = F.lit(False)
        for p in () if strict else GROUNDED_PREFIXES:
            known = known | s.startswith(p)
        words = F.exists(F.split(s, r"[\s,:;]+"), lambda t: (F.length(t) >= 3) & F.contains(text, t))
        return (F.length(s) > 0) & (known | words)

    return F.when(F.size(evidence) > 0, F.size(F.filter(evidence, grounded)) / F.size(evidence)).otherwise(0.0)


def rationale(obj: Column) -> Column:
    """``struct<reasoning, evidence>`` of a teacher's answer, or null where its reasoning is no text; evidence has at most
    five items."""
    raw = raw_fields(obj)
    why = strip(raw["reasoning"])
    return F.when(F.length(why) > 0, F.struct(why.alias("reasoning"), F.slice(text_list(raw["evidence"]), 1, 5).alias("evidence")))

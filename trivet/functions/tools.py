"""Read-only checks that a triage loop may call, as columns; a registry names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trivet.functions.text import features, value_hash

#: Terms that mark a placeholder.
PLACEHOLDER_TERMS = ("your_", "example", "sample", "demo", "dummy", "fake", "changeme", "placeholder", "password123", "xxxx", "redacted")
#: What a context may signal.
CONTEXT_SIGNALS = {
    "has_password_key": r"\b(pass|password|pwd|secret|token|key)\b",
    "has_username": r"\b(user|username|login|account|cuenta|correo|utenza)\b",
    "has_host": r"\b(host|url|server|db_host)\b",
    "has_reset_language": r"reset|recover|policy|expired|change password",
    "has_ticket": r"\b(?:INC|RITM|CHG)\d+\b",
    "has_url": r"https?://",
}
#: Parts of a path, the first class that has one wins.
PATH_CLASSES = {
    "test_fixture": ("test", "tests", "fixture", "sample", "dummy"),
    "documentation": ("readme", "docs", "documentation"),
    "config": ("prod", ".env", "config", "settings", "deploy", "workflow"),
}
#: Shapes of well-known secrets.
SECRET_SHAPES = {"aws_key": r"^AKIA[0-9A-Z]{16}$", "jwt": r"^eyJ[\w-]+\.[\w-]+\.[\w-]*$", "hex_digest": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", "uuid": r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"}


def _tool(name: str, **fields: Column) -> Column:
    return F.struct(F.lit(name).alias("tool"), F.lit("ok").alias("status"), *[c.alias(k) for k, c in fields.items()])


def entropy_check(value: Column) -> Column:
    return _tool("entropy_check", features=features(value))


def placeholder_terms(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.filter(F.array(*map(F.lit, PLACEHOLDER_TERMS)), lambda t: F.contains(low, t))


def placeholder_check(value: Column) -> Column:
    found = placeholder_terms(value)
    return _tool("placeholder_check", matched_terms=found, is_placeholder=F.size(found) > 0)


def context_signals(context: Column) -> Column:
    text = F.coalesce(context, F.lit(""))
    return F.struct(*[text.rlike(f"(?iU){p}").alias(k) for k, p in CONTEXT_SIGNALS.items()])


def context_signal_check(context: Column) -> Column:
    return _tool("context_signal_check", signals=context_signals(context))


def path_class(path: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    out = None
    for name, terms in PATH_CLASSES.items():
        hit = low.rlike("|".join(t.replace(".", r"\.") for t in terms))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("source")


def file_path_check(path: Column) -> Column:
    return _tool("file_path_check", path_class=path_class(path))


def duplicate_secret_check(value: Column, seen_before: Column) -> Column:
    """``seen_before`` comes from the run's duplicates, see :func:`trivet.operators.clusters.mark_duplicates`."""
    h = value_hash(value)
    return _tool("duplicate_secret_check", value_hash=h, is_duplicate=h.isNotNull() & F.coalesce(seen_before, F.lit(False)))


def pattern_check(value: Column) -> Column:
    """The first well-known shape that the value has, or null."""
    out = None
    for name, pattern in SECRET_SHAPES.items():
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return _tool("pattern_check", shape=out)


def fixture_check(path: Column, value: Column) -> Column:
    return _tool("fixture_check", is_fixture=(path_class(path) == "test_fixture") | (F.size(placeholder_terms(value)) > 0))


def git_blame_check(author: Column, changed_at: Column, scanned_at: Column) -> Column:
    """Who changed the line last, as a hash, and how many days before the scan; for detections that have these columns."""
    days = F.datediff(F.to_date(scanned_at), F.to_date(changed_at))
    return _tool("git_blame_check", author_hash=value_hash(author), age_days=days)


#: Tools by name: (fields of the detection that they take, function of these columns). Add an entry to add a tool.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "entropy_check": (("matched_value",), entropy_check),
    "placeholder_check": (("matched_value",), placeholder_check),
    "context_signal_check": (("context",), context_signal_check),
    "file_path_check": (("file_path",), file_path_check),
    "duplicate_secret_check": (("matched_value", "seen_before"), duplicate_secret_check),
    "pattern_check": (("matched_value",), pattern_check),
    "fixture_check": (("file_path", "matched_value"), fixture_check),
    "git_blame_check": (("author", "changed_at", "scanned_at"), git_blame_check),
}


def observation(action: Column, args: Column, available: set[str]) -> Column:
    """JSON of the tool that ``action`` names, with arguments from the map ``args`` before those of the detection; null
    for an unknown action. Only the branch of the row's own action is evaluated."""
    out = F.lit(None).cast("string")
    for name, (fields, fn) in REGISTRY.items():
        if all(f in available for f in fields):
            given = [F.coalesce(F.try_element_at(args, F.lit({"matched_value": "value"}.get(f, f))), F.col(f).cast("string")) if f != "seen_before" else F.col(f) for f in fields]
            out = F.when(action == name, F.to_json(fn(*given))).otherwise(out)
    return out


def basic_tools(value: Column, context: Column, path: Column) -> Column:
    """JSON array of the four checks that need nothing but the detection."""
    checks = [entropy_check(value), placeholder_check(value), context_signal_check(context), file_path_check(path)]
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.to_json(c) for c in checks]), F.lit("]"))


def register_sql(spark: SparkSession) -> list[str]:
    """The tools' scalar parts as functions of SQL, without any Python worker; returns their names."""
    text = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    terms = ", ".join(map(text, PLACEHOLDER_TERMS))
    classes = " ".join(f"WHEN rlike(p, {text('|'.join(t.replace('.', chr(92) + '.') for t in ts))}) THEN {text(name)}" for name, ts in PATH_CLASSES.items())
    shapes = " ".join(f"WHEN rlike(v, {text(p)}) THEN {text(name)}" for name, p in SECRET_SHAPES.items())
    chars = "filter(array_distinct(split(v, '')), c -> c != '')"
    found = {
        "value_entropy": ("v STRING", "DOUBLE", f"coalesce(aggregate(transform({chars}, c -> (length(v) - length(replace(v, c, ''))) / length(v)), 0.0D, (acc, p) -> acc - p * log2(p)), 0.0D)"),
        "value_hash": ("v STRING", "STRING", "CASE WHEN length(v) > 0 THEN substr(sha2(v, 256), 1, 16) END"),
        "placeholder_terms": ("v STRING", "ARRAY<STRING>", f"filter(array({terms}), t -> contains(lower(coalesce(v, '')), t))"),
        "path_class": ("path STRING", "STRING", f"element_at(transform(array(replace(lower(coalesce(path, '')), '\\\\', '/')), p -> CASE {classes} ELSE 'source' END), 1)"),
        "secret_shape": ("v STRING", "STRING", f"CASE {shapes} END"),
    }
    for name, (takes, gives, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return list(found)

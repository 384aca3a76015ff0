"""String features, normalisation, hashes, prompts and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivet.schema import STATUSES

_BLANK = r"[\s\x1c-\x1f]+"
#: Texts that stand for "no value".
NULL_WORDS = ("", "None", "null", "NULL")
HIGH_ENTROPY = 3.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it and whatever the optimiser merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(v: Column) -> Column:
    """Without white space at both ends, Unicode's included (``trim`` only knows the space)."""
    return F.regexp_replace(v, rf"(?U)^{_BLANK}|{_BLANK}$", "")


def entropy(v: Column) -> Column:
    """Shannon entropy in bits a character; 0 for null and empty values. Meant for values, not for long texts: the work
    is length times distinct characters."""
    n = F.length(v)
    chars = F.filter(F.array_distinct(F.split(v, "")), lambda c: c != "")
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n)
    return F.coalesce(F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))), F.lit(0.0))


def features(v: Column) -> Column:
    """Entropy, length and the character classes that occur."""
    t = F.coalesce(v, F.lit(""))
    return F.struct(
        entropy(t).alias("entropy"),
        F.length(t).alias("length"),
        t.rlike(r"[^\p{L}\p{N}]").alias("has_special"),
        t.rlike(r"\p{IsUppercase}").alias("has_upper"),
        t.rlike(r"\p{IsLowercase}").alias("has_lower"),
        t.rlike(r"[\p{Nd}²³¹]").alias("has_digit"),
    )


def normalize_status(v: Column) -> Column:
    """Upper case, stripped, spaces as underscores; anything unknown is REVIEW."""
    s = F.replace(strip(F.upper(v)), F.lit(" "), F.lit("_"))
    return F.when(s.isin(*STATUSES), s).otherwise("REVIEW")


def is_real(status: Column) -> Column:
    """1 for REAL, else 0, after normalisation."""
    return F.when(normalize_status(status) == "REAL", 1).otherwise(0)


def context_hash(context: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(context, F.lit("")), 256))


def value_hash(v: Column) -> Column:
    """16 hex digits that may be logged in place of the value; null for null and empty values."""
    return F.when(F.length(v) > 0, F.substring(F.sha2(v, 256), 1, 16))


def clean_field(v: Column) -> Column:
    """Stripped, without trailing commas and one pair of quotes around; words for "no value" are null."""
    s = F.regexp_replace(strip(v), ",+$", "")
    quoted = (s.startswith('"') & s.endswith('"')) | (s.startswith("'") & s.endswith("'"))
    bare = F.when(quoted, F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)
    return F.when(~s.isin(*NULL_WORDS), F.nullif(strip(bare), F.lit("")))


def fold_null(v: Column) -> Column:
    return F.when(~v.isin(*NULL_WORDS), v)


def cut_context(v: Column, chars: int = 600) -> Column:
    """The context as records keep it: stripped, then the first ``chars`` code points."""
    return F.substring(strip(F.coalesce(v, F.lit(""))), 1, chars)


def prompt(file_path: Column, source: Column, pattern: Column, value: Column, context: Column) -> Column:
    """The text that a decision model reads; a missing source is ``unknown``."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(
        F.lit("File: "), none(file_path), F.lit(" | Source: "), F.coalesce(source, F.lit("unknown")),
        F.lit("\nPattern: "), none(pattern), F.lit(" | Match: "), none(value), F.lit("\nContext:\n"), none(context),
    )


def prompt_field(text: Column, name: str) -> Column:
    """A field of a prompt read back: file_path, source, pattern_name, matched_value or context; null if missing."""
    pattern = {
        "file_path": r"File: (.*?) \| Source:",
        "source": r"\| Source: ([^\n]*)",
        "pattern_name": r"Pattern: (.*?) \| Match:",
        "matched_value": r"\| Match: ([^\n]*)",
        "context": r"(?s)Context:\n(.*)",
    }[name]
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def with_username(username: Column, context: Column) -> Column:
    """The context, headed by the user name unless that is in it."""
    context = F.coalesce(context, F.lit(""))
    line = F.concat(F.lit("username="), username)
    return F.when((F.length(username) > 0) & ~F.contains(context, line), F.concat(line, F.lit("\n"), context)).otherwise(context)


def default_reasoning(status: Column, distractor: Column) -> Column:
    return (
        F.when(status == "REAL", "Labelled as a real credential by its source.")
        .when(F.length(distractor) > 0, F.concat(F.lit("Labelled as a false positive by augmentation: "), distractor, F.lit(".")))
        .otherwise("Labelled as a false positive by its source.")
    )


def label_evidence(source_file: Column, distractor: Column, username: Column, value_entropy: Column) -> Column:
    """What a label rests on, in this order; only what holds."""
    items = F.array(
        F.concat(F.lit("source:"), F.coalesce(source_file, F.lit("unknown"))),
        F.when(F.length(distractor) > 0, F.concat(F.lit("distractor:"), distractor)),
        F.when(F.length(username) > 0, "near username"),
        F.when(value_entropy >= HIGH_ENTROPY, "high entropy"),
    )
    return F.filter(items, lambda x: x.isNotNull())


def completion(status: Column, reasoning: Column, evidence: Column) -> Column:
    """The JSON text that a model is trained to answer with."""
    s = normalize_status(status)
    trace = F.struct(
        F.lit("supervised_label").alias("strategy"),
        F.array(*map(F.lit, ("source_label", "features", "context"))).alias("checks"),
        F.array().cast("array<string>").alias("tool_calls"),
    )
    return F.to_json(
        F.struct(
            is_real(s).alias("is_credentials"), s.alias("status"), F.when(s == "REAL", 0.98).otherwise(0.95).alias("confidence"),
            reasoning.alias("reasoning"), evidence.alias("evidence"), trace.alias("agent_trace"),
        )
    )


def preview(v: Column, chars: int) -> Column:
    """One line of at most ``chars`` characters."""
    return F.translate(F.substring(v, 1, chars), "\n", " ")


def draw(n: int | Column, *parts: Column | str | int) -> Column:
    """A number from 0 to ``n`` - 1 that depends on nothing but ``parts``: sampling that is the same on any cluster."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def pick(options: Sequence[str | None], *parts: Column | str | int) -> Column:
    return F.get(F.array(*[F.lit(o).cast("string") for o in options]), draw(len(options), *parts).cast("int"))


def random_text(alphabet: str, length: Column | int, *parts: Column | str | int) -> Column:
    """A text over ``alphabet``, every character drawn by its place."""
    size = F.lit(length) if isinstance(length, int) else length
    chars = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit(alphabet), (draw(len(alphabet), *parts, i) + 1).cast("int"), F.lit(1)))
    return F.array_join(chars, "")

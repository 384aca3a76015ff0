"""Augmentation of false positives: tiered variants with drawn passwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivet.functions import text as T

#: Literals that variants draw from.
NONE_LITERALS = (None, "", "None", "null")
PLACEHOLDERS = ("your_password", "<PASSWORD>", "****", "xxxxxxxx", "changeme", "P@ssw0rd", "REDACTED", "PASSWORD_HERE", "***hidden***")
DICTIONARY_WORDS = ("password", "secret", "token", "admin", "temporary", "credential", "example", "sample", "reset", "policy")
#: Tokens of a context, in this order.
TOKEN_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+",
    r"(?i)\b(?:INC|RITM|CHG)\d+\b",
    r"\b[A-Z0-9_-]+\\[A-Z0-9._-]+\b",
    r"\b\d{4}[-/.]\d{2}[-/.]\d{2}\b",
    r"\b\d{2}[-/.]\d{2}[-/.]\d{4}\b",
    r"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b",
)


def context_tokens(context: Column) -> Column:
    found = [F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(p), F.lit(0)) for p in TOKEN_PATTERNS]
    return F.concat(*found)


def high_entropy(*parts: Column | str | int) -> Column:
    """A UUID, 40 or 64 hex digits."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = T.draw(3, "kind", *parts)
    return F.when(kind == 0, uuid).when(kind == 1, F.substring(h, 1, 40)).otherwise(h)


def password_pool(real: DataFrame) -> DataFrame:
    """``pool_index, pool_value``: true passwords numbered from 0. Numbers come from counts of 4096 digest ranges, so the
    pool is numbered without one global sort."""
    values = real.filter("password IS NOT NULL").select(F.col("password").alias("pool_value"), F.conv(F.substring(F.md5("password"), 1, 3), 16, 10).cast("int").alias("_r"), "record_id")
    before = F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    starts = values.groupBy("_r").count().withColumn("_start", F.coalesce(before, F.lit(0)))  # 4096 rows
    place = F.row_number().over(Window.partitionBy("_r").orderBy("pool_value", "record_id")) - 1
    return values.withColumn("_at", place).join(F.broadcast(starts.select("_r", "_start")), "_r").select((F.col("_start") + F.col("_at")).alias("pool_index"), "pool_value")


def augment_false_positives(false_positives: DataFrame, pool: DataFrame | None = None, per_parent: int = 3, seed: int = 42) -> DataFrame:
    """Up to three variants of every record, easy, medium and hard, all with label 0. ``pool`` is :func:`password_pool`;
    hard negatives take a true password from it by an equi-join on a drawn number."""
    n = min(max(per_parent, 0), 3)
    rid = F.col("record_id")
    coin = lambda name: T.draw(1000, seed, name, rid)
    tokens = context_tokens(F.col("context"))
    token = F.get(tokens, T.draw(F.greatest(F.size(tokens), F.lit(1)), seed, "token", rid).cast("int"))
    variant = lambda suffix, kind, value: F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    easy = F.when(coin("easy") < 500, variant("none", "none_literal", T.pick(NONE_LITERALS, seed, "none", rid))).otherwise(
        variant("placeholder", "placeholder", T.pick(PLACEHOLDERS, seed, "placeholder", rid))
    )
    medium = F.when(token.isNotNull() & (coin("medium") < 700), variant("context-token", "context_token", token)).otherwise(
        variant("dictionary", "dictionary_word", T.pick(DICTIONARY_WORDS, seed, "word", rid))
    )
    hard = F.when(coin("hard") < 500, variant("high-entropy", "high_entropy_non_secret", high_entropy(seed, rid))).otherwise(
        variant("hard-negative", "hard_negative", high_entropy(seed, "hard", rid))
    )
    if not n:
        return false_positives.limit(0)
    rows = false_positives.withColumn("_v", F.explode(F.array(*(easy, medium, hard)[:n])))
    value = F.col("_v.value")
    if pool is not None:
        size = pool.count()
        if size:
            spread = -1 - F.pmod(F.xxhash64(rid), F.lit(4096))  # numbers of no pool row, so that other variants do not meet in one task
            rows = rows.withColumn("_i", F.when(F.col("_v.kind") == "hard_negative", T.draw(size, seed, "pool", rid)).otherwise(spread))
            rows = rows.join(pool, F.col("_i") == F.col("pool_index"), "left")
            value = F.coalesce("pool_value", "_v.value")
    out = rows.select(
        *[c for c in false_positives.columns if c not in ("record_id", "password", "status", "is_credentials", "distractor_type", "augmentation_parent_id", "features")],
        F.concat("record_id", F.lit("-aug-"), "_v.suffix").alias("record_id"),
        value.alias("password"),
        F.lit("FALSE_POSITIVE").alias("status"),
        F.lit(0).alias("is_credentials"),
        F.col("_v.kind").alias("distractor_type"),
        F.col("record_id").alias("augmentation_parent_id"),
        T.features(value).alias("features"),
    )
    return out.select(*false_positives.columns)

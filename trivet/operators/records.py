"""Records: normalisation, de-duplication, caps, leakage-safe splits and prompt pairs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivet.functions import text as T

#: Id prefixes by status.
PREFIXES = {"REAL": "tp", "FALSE_POSITIVE": "fp", "REVIEW": "rv"}
DEDUP_KEYS = ("source_context_hash", "password", "status", "distractor_type")


def make_records(tuples: DataFrame, status: str, context_chars: int = 600) -> DataFrame:
    """Records of one label from ``source_file, source_index, context, username, password``. REAL rows without a password
    go; indexes keep the gap."""
    context = T.cut_context(F.col("context"), context_chars)
    rows = tuples.select(
        "source_file",
        F.col("source_index").cast("int").alias("source_index"),
        context.alias("context"),
        F.nullif(T.clean_field(F.col("username")), F.lit("")).alias("username"),
        T.clean_field(F.col("password")).alias("password"),
    )
    if status == "REAL":
        rows = rows.filter("password IS NOT NULL")
    prefix = PREFIXES.get(status, "rec")
    return rows.select(
        F.format_string(f"{prefix}-%06d", "source_index").alias("record_id"),
        "source_file",
        "source_index",
        "context",
        "username",
        T.fold_null(F.col("password")).alias("password"),
        T.normalize_status(F.lit(status)).alias("status"),
        T.is_real(F.lit(status)).alias("is_credentials"),
        F.lit(None).cast("string").alias("distractor_type"),
        T.context_hash(F.col("context")).alias("source_context_hash"),
        F.lit(None).cast("string").alias("augmentation_parent_id"),
        T.features(F.col("password")).alias("features"),
    )


def order_key(seed: int, *keys: str) -> Column:
    """A place in a shuffle that depends on the seed and the row only."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(order_key(seed, *keys), *keys)


def first_of_key(rows: DataFrame, keys: tuple[str, ...] = DEDUP_KEYS, seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """One row of each key, nulls being equal: the first in the seeded shuffle. The least row is found by aggregation, so
    a key of many rows is reduced before it moves."""
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(order_key(seed, id_col), F.col(id_col))).alias("row"))
    return packed.select("row.*")


def cap_per_class(rows: DataFrame, cap: int, seed: int = 42, class_col: str = "status", id_col: str = "record_id") -> DataFrame:
    """At most ``cap`` rows of each class (all, if 0 or less). Spark limits each partition's window before it moves rows."""
    if cap <= 0:
        return rows
    place = F.row_number().over(Window.partitionBy(class_col).orderBy(order_key(seed, id_col), id_col))
    return rows.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def first_records(rows: DataFrame, limit: int, id_col: str = "record_id") -> DataFrame:
    """The first ``limit`` rows by id, all of them if it is 0 or less. Spark keeps the first of each partition before rows move."""
    return rows.orderBy(id_col).limit(limit) if limit > 0 else rows


def assign_splits(rows: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42, group_col: str = "source_context_hash") -> DataFrame:
    """A ``split`` for every row such that a group is in one split: of the groups in seeded order, the first
    ``floor(n * test)`` are test, the next ``floor(n * val)`` validation.

    Groups are placed without one global sort: a histogram over 4096 ranges of the order key gives the range that holds
    each limit, and only the groups of those two ranges are numbered.
    """
    groups = rows.select(group_col).distinct().select(F.col(group_col).alias("_g"), order_key(seed, group_col).alias("_k"))
    groups = groups.withColumn("_b", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    sizes = groups.groupBy("_b").count().orderBy("_b").collect()  # 4096 rows at most
    n = sum(r["count"] for r in sizes)
    limits = (int(n * test), int(n * test) + int(n * val))
    before, starts, open_ = 0, {}, set()
    for r in sizes:
        starts[r["_b"]] = before
        if any(before < x < before + r["count"] for x in limits):
            open_.add(r["_b"])
        before += r["count"]
    if not starts:
        return rows.withColumn("split", F.lit("train"))
    # Ranges stand in order, so the first one at or behind a limit parts the splits; two at most hold a limit.
    edges = [min((b for b, s in starts.items() if s >= x), default=4096) for x in limits]
    by_range = F.when(F.col("_b") < edges[0], "test").when(F.col("_b") < edges[1], "validation").otherwise("train")
    is_open = F.col("_b").isin(*open_) if open_ else F.lit(False)
    start = F.coalesce(*[F.when(F.col("_b") == b, starts[b]) for b in sorted(open_)], F.lit(0))
    place = start + F.row_number().over(Window.partitionBy("_b").orderBy("_k", "_g")) - 1
    exact = groups.filter(is_open).withColumn("_p", place)
    exact = exact.select("_g", F.when(F.col("_p") < limits[0], "test").when(F.col("_p") < limits[1], "validation").otherwise("train").alias("_s"))
    keyed = rows.withColumn("_b", F.conv(F.substring(order_key(seed, group_col), 1, 3), 16, 10).cast("int"))
    joined = keyed.join(exact, F.col(group_col).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("split", F.coalesce("_s", by_range)).drop("_b", "_g", "_s")


def leaked_groups(rows: DataFrame, group_col: str = "source_context_hash", split_col: str = "split") -> DataFrame:
    """Groups that occur in more than one split; must be empty."""
    return rows.groupBy(group_col).agg(F.min(split_col).alias("a"), F.max(split_col).alias("b")).filter("a <> b").select(group_col)


def prompt_pairs(records: DataFrame, rationales: DataFrame | None = None) -> DataFrame:
    """Training prompts and completions; a rationale of the record's id replaces reasoning and, if it has any, evidence."""
    rows = records
    if rationales is not None:
        rows = rows.join(rationales.select("record_id", F.col("reasoning").alias("_why"), F.col("evidence").alias("_what")), "record_id", "left")
    else:
        rows = rows.withColumn("_why", F.lit(None).cast("string")).withColumn("_what", F.lit(None).cast("array<string>"))
    context = T.with_username(F.col("username"), F.col("context"))
    text = T.prompt(F.lit("synthetic/training_sample"), F.coalesce("source_file", F.lit("synthetic_dataset")), F.lit("PASSWORD"), F.col("password"), context)
    own = T.label_evidence(F.col("source_file"), F.col("distractor_type"), F.col("username"), F.col("features.entropy"))
    why = F.coalesce(F.nullif("_why", F.lit("")), T.default_reasoning(F.col("status"), F.col("distractor_type")))
    what = F.when(F.size("_what") > 0, F.col("_what")).otherwise(own)
    return rows.select(text.alias("prompt"), T.completion(F.col("status"), why, what).alias("completion"), "record_id", "status", "is_credentials", "distractor_type", "source_context_hash")


def class_weights(rows: DataFrame, class_col: str = "status") -> DataFrame:
    """``class, n, weight``: weights that balance the classes."""
    n = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return n.join(F.broadcast(total)).select(class_col, "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def expire(rows: DataFrame, seen_col: str, now: Column, days: int = 30) -> DataFrame:
    """Rows still inside the retention period."""
    return rows.filter(F.col(seen_col) >= now - F.expr(f"INTERVAL {days} DAYS"))


def resampled(rows: DataFrame, size: int, class_col: str = "status", id_col: str = "record_id", seed: int = 42) -> DataFrame:
    """Each class brought to about ``size`` rows: a larger one keeps each row with the same chance, a smaller one repeats its
    rows, with a ``copy`` number from 0. Chances are digests of seed and id."""
    n = rows.groupBy(class_col).agg((F.lit(size) / F.count(F.lit(1))).alias("_rate")).withColumnRenamed(class_col, "_class")
    joined = rows.join(F.broadcast(n), F.col(class_col).eqNullSafe(F.col("_class")))  # a row for each class
    whole = F.floor("_rate")
    more = T.draw(1_000_000, seed, "resample", F.col(id_col)) < (F.col("_rate") - whole) * 1_000_000
    copies = (whole + more.cast("int")).cast("int")
    return joined.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)))).drop("_rate", "_class")


def provenance(rows: DataFrame, seed: int, prompts: tuple[str, ...], **more: str) -> DataFrame:
    """One row that tells where a dataset comes from: row count, a digest of its rows that does not depend on their order,
    its schema's and the prompts' versions, the seed, and what else is given."""
    version = hashlib.sha256("\x00".join(prompts).encode()).hexdigest()[:16]
    shape = hashlib.sha256(rows.schema.json().encode()).hexdigest()[:16]
    digest = F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*rows.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(digest, F.lit("0")).alias("content_digest"))
    return out.withColumns({"prompt_version": F.lit(version), "schema_version": F.lit(shape), "seed": F.lit(seed)} | {k: F.lit(v) for k, v in more.items()})

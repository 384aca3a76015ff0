"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Every normalised text is cut where its own content says so, so equal stretches give equal chunks wherever they stand.
Chunk contents move once, deduplicated map-side, to verify that no identifier stands for two contents. From then on a
document is its recipe, the ordered list of its chunk identifiers, and only recipes are compared and shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import ascii_lower, cut

#: Identifiers in order of width. A wider one is taken only when content shows that a narrower one is ambiguous.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (lambda c: F.xxhash64(c), lambda c: F.sha2(c, 256))


def chunk_pattern(min_chars: int, max_chars: int) -> str:
    """A chunk ends at the first white space before m, s or t past ``min_chars``, or at ``max_chars``."""
    return rf"(?s).{{{min_chars},{max_chars - 2}}}?(?:\s[mst]|\z)|.{{1,{max_chars}}}"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = 1024,
    max_chunk: int = 16384,
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
    salts: int = 8,
) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z; the largest id of a group stays.

    Returns ``doc_id, keep_id, group_size long, kept boolean, text_sha256, n_chunks int``, a row for each input row.

    * null and empty texts are one group (the empty text, an empty recipe).
    * repeated rows count in ``group_size``; rows that share the largest id all have ``kept`` true.
    * null ids never win; in a group of null ids only, ``keep_id`` is null and ``kept`` is false except for a group of one.
    * very long texts: at most ``max_chunk`` characters a chunk; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    pattern = F.lit(chunk_pattern(min_chunk, max_chunk))
    chunks = F.regexp_extract_all("norm", pattern, F.lit(0))
    for identify in identifiers:
        pairs = src.select(F.explode(chunks).alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
        if pairs.groupBy("id").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("no identifier tells all chunk contents apart")
    base = cut(
        src.select(
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks, identify).alias("recipe"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    # Groups of two and more only, once for each salt: a hot group's rows spread over `salts` tasks in the join back.
    groups = (
        base.groupBy("recipe")
        .agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    out = base.join(groups, ["recipe", "salt"], "left")
    single = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(single | (F.col("doc_id") == F.col("best")), F.lit(False)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha
      FROM documents)
WINDOW w AS (PARTITION BY sha)
"""

"""The corpus pipeline: language, copies, near copies, mixture, encoding.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.llm import bpe_words, exact_dedup, language, mixing, ngram_join
from trivet.llm.common import Scratch, ascii_lower, cut, table
from trivet.llm.queries import tokenizer

#: Texts of which a smaller share of n-grams belongs to any one language are rejected.
LEAST_SCORE = 0.4
#: Every document is taken once at least; small sources repeat within the mixture's limit.
MIXTURE = mixing.Mixture(budget="cover")
#: Characters of texts whose words are encoded together: executors that run all stages have less room than one query has.
ENCODED_CHARS = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets texts in batches of 4 MB and 1,000 rows at most, for as long as the session runs: rows are texts, and
    a batch is held in the JVM and in the worker."""
    for key, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text belongs to a language; null and empty texts and texts without letters go. What is learned comes
    from the documents given. Repeated rows share their fate, ids may be null, texts of any length are read whole, an empty
    table gives no rows; a tie between languages goes to the first by name and decides nothing here. Rows keep all their
    columns, whatever their names."""
    small_batches(spark)
    found = language.language_of(spark, language.fit(docs))(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return rows.filter((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def text_print(text: Column, digest: Callable[[Column], Column]) -> Column:
    """What equal texts, in the sense of ``exact_dedup``, have in common."""
    return digest(ascii_lower(F.coalesce(text, F.lit(""))))


def only(docs: DataFrame, digest: Callable[[Column], Column], kept: DataFrame) -> DataFrame:
    """The documents named by ``id, own`` (id and digest of the text), with all their columns. A row whose id is null has no name
    but its text: of such rows with equal texts one stays, the first by the digest of the row."""
    kept = cut(kept.distinct()).alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_print(F.col("text"), digest).alias("own")).alias("r")
    same = F.col("r.own") == F.col("k.own")
    named = rows.filter("id IS NOT NULL").join(kept.filter("id IS NOT NULL"), (F.col("r.id") == F.col("k.id")) & same, "left_semi")
    nameless = rows.filter("id IS NULL").join(kept.filter("id IS NULL"), same, "left_semi")
    one = nameless.groupBy("own").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return named.select("row.*").unionByName(one.select("row.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id; rows that repeat its id and its text stay with
    it. A group of null ids only keeps one row. Null and empty texts are equal to each other."""
    small_batches(spark)
    found = exact_dedup.exact_dedup(docs).filter("kept AND doc_id IS NOT NULL OR keep_id IS NULL")
    return only(docs, lambda t: F.sha2(t, 256), found.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("own")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links join; documents without words stay, null and empty texts
    among them. Among rows of one id the digest of the text decides, and so it does in a group of null ids only."""
    small_batches(spark)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_print(F.col("text"), digest).alias("own"))
    found = ngram_join.jaccard_join(docs.select(name.alias("doc_id"), "text")).filter("doc_id = component_id")
    return only(docs, digest, found.select(F.col("doc_id.id").alias("id"), F.col("doc_id.own").alias("own")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, once at least. A null source is a source; repeated rows and
    null ids count as documents, ties in the blocks' order go by the digest of the row, empty texts weigh nothing and stay
    once, texts of any length weigh their tokens."""
    small_batches(spark)
    return mixing.realise(docs, MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its digest after decoding. A row for each row: repeated rows and null ids too; a
    null text has no tokens; texts of any length are encoded whole."""
    small_batches(spark)
    return bpe_words.encode_decode(docs, tokenizer("word_bpe_49k.json"), batch_chars=ENCODED_CHARS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_language),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("mixture", mix),
    ("encode", encode),
]
#: Language identification and word-piece merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf_dir))
        scratch.free(docs)  # nothing reads the stage before any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

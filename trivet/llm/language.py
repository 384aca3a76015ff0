"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter answers for all languages at once: each place holds a mask with one bit per language (as many
words of 64 bits as the languages need), and the AND over an n-gram's places is the set of languages that contain it. A text's n-grams are looked up, a popcount per
language is taken, corrected for the false positives expected at the language's fill rate, and the largest one decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.llm.common import give_back
from trivet.llm.shingles import U, batches_of, mix

SIZES = (2, 3, 4)
HASHES = 3
SPACE = 32
GROUP_CHARS = 200_000  # characters looked up at once


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case letter of every code point, or a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prints of all n-grams of letters (a space may begin or end one), the text of each, and whether texts have letters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = letters()[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    text_of = np.append(np.append(0, text_of), len(texts) - 1)[: len(codes)]  # a leading space, then each text and its space
    solid = codes != SPACE
    spread = codes.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    prints, owners = [], []
    for n in SIZES:
        last = len(codes) - n + 1
        if last < 1:
            continue
        ok = solid[1:last + 1] if n > 2 else solid[:last] | solid[1 : last + 1]
        if n == 4:
            ok = ok & solid[2 : last + 2]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ spread[at + j]) * U(0xD6E8FEB86659FD93)
            h ^= h >> U(32)
        prints.append(mix(h))
        owners.append(text_of[np.where(solid[at + 1], at + 1, at)])
    has = np.bincount(text_of, weights=solid, minlength=len(texts)) > 0
    if not prints:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    return np.concatenate(prints), np.concatenate(owners), has


class Filter:
    """``masks[word, place]`` has a bit for each language; a gram is in a language when all its places have the bit."""

    def __init__(self, langs: list[str], prints: np.ndarray, members: np.ndarray):
        """``members`` are places in ``langs``; a gram of several languages stands several times."""
        self.langs = langs
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(np.unique(prints))) * 10))))
        self.kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.width = 8 * self.kind().nbytes
        self.masks = np.zeros((-(-len(langs) // self.width), 1 << self.bits), self.kind)
        bit = np.left_shift(self.kind(1), (members % self.width).astype(self.kind))
        for place in self.places(prints):
            np.bitwise_or.at(self.masks, (members // self.width, place), bit)
        fill = np.array([self._bit(self.masks[i // self.width], i).mean() for i in range(len(langs))])
        self.chance = np.minimum(fill**HASHES, 0.99)

    def _bit(self, words: np.ndarray, lang: int) -> np.ndarray:
        return (words >> self.kind(lang % self.width)) & self.kind(1)

    def places(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        step = (prints >> U(40)) | U(1)
        for k in range(HASHES):
            yield ((prints + U(k) * step) & U((1 << self.bits) - 1)).astype(np.int64)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams that each language contains, the texts' n-grams, and who has letters."""
        prints, owners, has = grams(texts)
        places = list(self.places(prints))
        total = np.bincount(owners, minlength=len(texts))
        found = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            if i % self.width == 0:
                words = self.masks[i // self.width]
                mask = np.bitwise_and.reduce([words[place] for place in places])
            found[:, i] = np.bincount(owners, weights=self._bit(mask, i), minlength=len(texts))
        n = np.maximum(total, 1)[:, None]
        return np.clip((found - n * self.chance) / (1 - self.chance) / n, 0, 1), total, has


def fit(docs: DataFrame, per_language: int = 3000, share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter | None:
    """Learn from about ``per_language`` labelled texts of each language (a sample by print of id and text, so the model's
    size grows with the number of languages only), none of them held out. Every language is learned. A language contains an n-gram that occurs in it twice or
    more, at ``share`` or more of the rate that the n-gram has where it is most frequent. None without labelled texts."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    src = src.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    of_lang = docs.sparkSession.createDataFrame([(lang, i, per_language / sizes[lang]) for i, lang in enumerate(langs)], "lang string, l int, chance double")
    sample = src.withColumn("luck", luck).join(F.broadcast(of_lang), "lang").filter("luck < chance").select("text", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("l").to_numpy(zero_copy_only=False)
            at = 0
            for texts in batches_of(x.as_py() for x in batch.column("text")):
                prints, owners, _ = grams(texts)
                lang = of[at : at + len(texts)][owners]
                at += len(texts)
                for i in np.unique(lang):
                    own, n = np.unique(prints[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])
        give_back()

    counts = sample.mapInArrow(count, "l int, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("l").agg(F.sum("n").alias("all"))  # a row for each language
    rates = counts.join(F.broadcast(totals), "l").withColumn("rate", F.col("n") / F.col("all"))
    best = rates.groupBy("g").agg(F.max("rate").alias("top"), F.collect_list(F.struct("l", "n", "rate")).alias("each"))  # of languages at most
    kept = best.select("g", "top", F.explode("each").alias("x")).filter((F.col("x.n") >= 2) & (F.col("x.rate") >= share * F.col("top")))
    members = kept.select("g", "x.l").toArrow()  # bounded by the sample
    return Filter(langs, members.column("g").to_numpy().view(np.uint64), members.column("l").to_numpy().astype(np.int64))


def identify(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, held_out boolean, lang_pred string, score double`` for every row; one narrow pass, no shuffle.

    ``score`` is the share of the text's n-grams that the language contains, corrected for false positives. Ties go to
    the first language by name.

    * null and empty texts and texts without a letter are ``und`` with score 0, and so is everything without a model.
    * very long texts are read whole; repeated rows each give a row; an empty table gives no rows.
    * a null id is not held out; other columns of the input are not read.
    """
    found = language_of(docs.sparkSession, model)(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def language_of(spark: SparkSession, model: Filter | None) -> Callable[[Column], Column]:
    """A function of a text column: ``struct<lang_pred string, score double>``. Only that column goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for column in columns:
            names, scores = [], []
            for texts in batches_of(("" if x is None else x for x in column), chars=GROUP_CHARS):
                if found is None:
                    names += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                part, _, has = found.hits(texts)
                names += [found.langs[b] if h else "und" for b, h in zip(part.argmax(1), has)]
                scores += np.where(has, part.max(1), 0.0).tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})
        give_back()

    return F.pandas_udf(predict, "lang_pred string, score double")

"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark's tasks. The distinct words of each batch of texts go to the ranges that their hash
names, every distinct word is encoded there, once, and its ids come back to the batches, where they are joined with the
positions of the words (:mod:`trivet.llm.word_parts`). Decoding joins the ids with the table of pieces: in the query by
position in that table, which has one row for each id of the tokenizer and no more, in :func:`decode` as a join of rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from trivet.llm.common import no_cycles
from trivet.llm.word_parts import answered, pack, parts_for, small, split, unpack, with_answers

BATCH_CHARS = 6_000_000  # of texts whose distinct words move once

_SPACE = "\t-\r \x85\xa0  -     　"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ODD = re.compile("[\x1c-\x1f]")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def normal(text: str) -> str:
    """Case is mapped character by character: a final sigma is no exception."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def tokens_of(text: str, special: re.Pattern | None) -> list[str]:
    """Stretches between white space, normalised; no word crosses white space. A special token's string is looked for in
    the text as it is and stands for itself, behind a line break. Separators that only Python takes for white space keep
    their stretch whole."""
    if special is not None and (parts := special.split(text))[1:]:
        return [t for i, part in enumerate(parts) for t in (["\n" + part] if i % 2 else tokens_of(part, None))]
    text = normal(text)
    return [" " + text] if _ODD.search(text) else text.split()


def words_of(token: str) -> list[str]:
    """The words that merges never cross, in order."""
    if token[:1] == "\n":
        return [token[1:]]
    if token.isascii():  # most tokens: a word, or a word and a mark
        if token.isalpha():
            return [token]
        if token[-1] in ",.!?;:" and token[:-1].isalpha():
            return [token[:-1], token[-1]]
    return _ASCII.findall(token) if token.isascii() else _ANY.findall(token)


def special_pattern(special: list[str]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


class WordCoder:
    """The tokenizer, for words that are already normalised and split; one for each worker."""

    _live: dict[str, WordCoder] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        whole = Tokenizer.from_str(spec)
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.pieces = sorted((i, piece) for piece, i in whole.get_vocab(with_added_tokens=True).items())
        whole.normalizer = normalizers.Sequence([])
        whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        whole.no_truncation()
        whole.no_padding()
        self.coder = whole

    @classmethod
    def of(cls, spec: str) -> WordCoder:
        if spec not in cls._live:
            cls._live.clear()
            cls._live[spec] = cls(spec)
        return cls._live[spec]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch(words, add_special_tokens=False)]

    def piece_table(self) -> pa.Array:
        """The piece of every id, by place; ids that are not used have null."""
        out: list[str | None] = [None] * (self.pieces[-1][0] + 1 if self.pieces else 0)
        for i, piece in self.pieces:
            out[i] = piece
        return pa.array(out, pa.string())


def positions_of(texts: list[str], special: re.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, every position's word by number, and each text's number of words."""
    tokens: dict[str, int] = {}
    found, sizes = array("I"), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):  # one text's tokens at a time; only distinct ones stay
        own = [tokens.setdefault(t, len(tokens)) for t in tokens_of(text, special)]
        sizes[i] = len(own)
        found.extend(own)
    number: dict[str, int] = {}
    of_token = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in tokens]
    counts = np.fromiter(map(len, of_token), np.int64, len(of_token))
    flat = np.fromiter((w for ws in of_token for w in ws), np.int64, int(counts.sum()))
    at = np.frombuffer(found, np.uint32).astype(np.int64)
    positions = spread(flat, counts, at)
    ends = np.append(0, np.cumsum(counts[at]))[np.append(0, np.cumsum(sizes))]
    return list(number), positions, np.diff(ends)


def spread(flat: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The items of the lists ``at`` one after the other; list i has ``counts[i]`` items of ``flat``."""
    starts, n = (np.cumsum(counts) - counts)[at], counts[at]
    return flat[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Return ``doc_id, n_tokens long, ids_sha256, decoded_sha256`` for every row, with ``texts`` also ``ids array<int>``
    and ``decoded string``.

    * null and empty texts have no tokens and decode to the empty text; an empty table gives no rows.
    * repeated rows each give a row; null ids are allowed; special strings inside texts are their tokens.
    * very long texts are encoded whole; other columns of the input are not read.
    * ``batch_chars`` steers the work only: smaller batches of texts take less memory and more of the exchange.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    special = special_pattern(WordCoder.of(spec).special)
    shared = spark.sparkContext.broadcast(spec)  # of the tokenizer's size
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    parts = parts_for(src)

    def tokenise(group: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        with no_cycles():
            return positions_of(group, special)

    dealt = split(src, parts, tokenise, batch_chars)

    def encode(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple[str, int, bytes]]:
        """Each distinct word of a range is encoded when it is met first."""
        coder, known = WordCoder.of(shared.value), {}
        for name, part, data in rows:
            if part < 0:
                yield name, part, data
                continue
            words = unpack(data)[0].tobytes().decode().split("\n")
            new = [w for w in words if w not in known]
            known.update(zip(new, (np.array(ids, np.uint32) for ids in coder.encode(new))))
            ids = [known[w] for w in words]
            yield name, part, pack(small(np.fromiter(map(len, ids), np.int64, len(ids))), small(np.concatenate(ids)))

    more = ", ids array<int>, decoded string" if texts else ""
    kind = src.schema["doc_id"].dataType.simpleString()

    def finish(ids: pa.Array, own: tuple[np.ndarray, np.ndarray, np.ndarray], found: list[list[np.ndarray]]) -> pa.Table:
        sizes, _, positions = own
        counts = np.concatenate([*(f[0].astype(np.int64) for f in found), np.empty(0, np.int64)])
        flat = np.concatenate([*(f[1].astype(np.int64) for f in found), np.empty(0, np.int64)])
        ends = np.append(0, np.cumsum(counts[positions]))[np.append(0, np.cumsum(sizes))]
        at = pa.array(spread(flat, counts, positions))
        pieces, names = Spelling.of(shared.value)
        lists = lambda values: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(at)), " ").to_pylist()
        coded, decoded = lists(names), lists(pieces)
        columns = [ids, pa.array(np.diff(ends)), *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs]) for xs in (coded, decoded))]
        if texts:
            columns += [pa.array([[int(x) for x in t.split()] for t in coded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])])

    return with_answers(answered(dealt, parts, encode), finish, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


class Spelling:
    """Pieces and decimal texts of all ids, made once for each worker."""

    _live: dict[str, tuple[pa.Array, pa.Array]] = {}

    @classmethod
    def of(cls, spec: str) -> tuple[pa.Array, pa.Array]:
        if spec not in cls._live:
            cls._live.clear()
            pieces = WordCoder.of(spec).piece_table()
            cls._live[spec] = pieces, pa.array(map(str, range(len(pieces))), pa.string())
        return cls._live[spec]


def decode(coded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` of id lists by a join with the table of pieces; null and empty lists decode to the empty text,
    an id outside the vocabulary is skipped, repeated ids of documents need distinct ``id_col`` values."""
    spark: SparkSession = coded.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = spark.createDataFrame(WordCoder(f.read()).pieces, "id int, piece string")
    rows = coded.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(ids_col).alias("pos", "id"))
    joined = rows.join(F.broadcast(pieces), "id", "left")
    parts = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), " ").alias("decoded"))

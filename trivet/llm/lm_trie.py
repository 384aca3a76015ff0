"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model, smoothed towards the add-one unigram model p1 by a Dirichlet prior of weight ``mu``:

    p(w | v) = (c(v, w) + mu * p1(w)) / (c(v) + mu)

A token's log10 probability is that of an unseen bigram, which needs the counts of its two words only, and for a bigram
seen in training the gain log10(1 + c(v, w) / (mu * p1(w))). Every word and every bigram of the training texts counts.

Words are told apart by their letters. The distinct words of each batch of texts go to the ranges that their hash names and
come back with a number and their count in training (:mod:`trivet.llm.word_parts`). Then every bigram of known words goes,
packed, to the part of its context; a context of more than ``SALT`` occurrences is dealt over several parts by successor.
A bigram of ``REPEATED`` occurrences or more in a batch goes there once, with its count, and its gain comes back to them: so
no part gets more than a few entries of a batch for one bigram, however common it is. There the training counts become a
trie: contexts, monotone pointers to their successors, and the successors of all contexts in Elias-Fano form with quantised
gains, written to a file that is mapped into memory. Bigrams of all texts are looked up in it, by successor search inside
their context's range, and sums go back to the texts. No word list, count or part of the model is ever in the driver or in
one place, and what a part holds is bounded by the number of parts.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import Scratch
from trivet.llm.shingles import U, mix
from trivet.llm.shingles import words_of as split_words
from trivet.llm.word_parts import answered, pack, parts_for, planes, ranks, small, split, unpack, with_answers

START, END = 0, 1  # numbers of the context that begins a text, and of the token that ends one; words follow
STEP = 512  # quantisation: steps in one unit of log10
SALT = 200_000  # training occurrences of a context in one part, about
REPEATED = 4  # occurrences in a batch from which a bigram goes to its part once, with its count


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class Levels:
    """Arrays in one file without a name, mapped into memory: pages are read when they are asked for, and the file is gone
    with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def put(self, values: np.ndarray) -> np.ndarray:
        if not values.nbytes:
            return values
        at = -(-self.file.tell() // mmap.ALLOCATIONGRANULARITY) * mmap.ALLOCATIONGRANULARITY
        self.file.seek(at)
        self.file.write(values.tobytes())
        self.file.flush()
        return np.frombuffer(mmap.mmap(self.file.fileno(), values.nbytes, access=mmap.ACCESS_READ, offset=at), values.dtype)

    def __enter__(self) -> Levels:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1, dtype=np.uint8)
#: The place of each byte's k-th one.
_PLACE = np.array([[*np.flatnonzero(b), *[0] * (8 - b.sum())] for b in _BITS], np.int64)


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the ``k``-th one, counted from 0, in each row of eight bytes."""
    upto = np.cumsum(_ONES[words], axis=1, dtype=np.uint8)
    byte = (upto > k[:, None]).argmax(1)
    row = np.arange(len(k))
    own = words[row, byte]
    return byte * 8 + _PLACE[own, k - (upto[row, byte] - _ONES[own])]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with zero counts for each 64-bit word."""

    def __init__(self, values: np.ndarray):
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n = n
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & U(1)).astype(np.uint8).ravel() if n * self.low_bits < 1 << 26 else self._low_bits(values)
        self.low = np.frombuffer(np.packbits(bits, bitorder="little").tobytes() + bytes(16), np.uint8)
        high = (values >> U(self.low_bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 0
        unary = np.zeros(n + self.buckets + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        unary = np.append(unary, np.ones(-len(unary) % 64, np.uint8))  # a full last word, without more zeros
        self.high = np.packbits(unary, bitorder="little")
        self.zeros = np.cumsum(64 - unary.reshape(-1, 64).sum(1, dtype=np.int64))

    def mapped(self, levels: Levels) -> EliasFano:
        """The same sequence, read from a file."""
        self.low, self.high, self.zeros = map(levels.put, (self.low, self.high, self.zeros))
        return self

    def _low_bits(self, values: np.ndarray) -> np.ndarray:
        parts = [((values[i : i + 1_000_000, None] >> np.arange(self.low_bits, dtype=np.uint64)) & U(1)).astype(np.uint8).ravel() for i in range(0, len(values), 1_000_000)]
        return np.concatenate(parts)

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        byte = bit >> 3
        out = np.zeros(len(at), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << U(8 * k)
        return (out >> (bit & 7).astype(np.uint64)) & U((1 << self.low_bits) - 1)

    def bucket_ends(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part of ``bucket`` or less: the place of the zero that ends it, less the zeros."""
        word = np.searchsorted(self.zeros, bucket, side="right")
        before = np.where(word > 0, self.zeros[word - 1], 0)
        out = np.empty(len(bucket), np.int64)
        for i in range(0, len(bucket), 200_000):
            part = slice(i, i + 200_000)
            place = select(~self.high.reshape(-1, 8)[word[part]], bucket[part] - before[part])
            out[part] = word[part] * 64 + place - bucket[part]
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value of ``x`` or more."""
        x = x.astype(np.uint64)
        bucket = np.minimum((x >> U(self.low_bits)).astype(np.int64), self.buckets - 1)
        beyond = (x >> U(self.low_bits)).astype(np.int64) >= self.buckets
        hi = self.bucket_ends(bucket)
        lo = np.where(bucket > 0, self.bucket_ends(np.maximum(bucket - 1, 0)), 0)
        want, end = x & U((1 << self.low_bits) - 1), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self.lows(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return np.where(beyond, self.n, np.minimum(lo, end))

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at places ``at``: the place of the one that stands for each, less the ones before it."""
        ones = 64 * np.arange(1, len(self.zeros) + 1) - self.zeros
        word = np.searchsorted(ones, at, side="right")
        before = np.where(word > 0, ones[word - 1], 0)
        high = np.empty(len(at), np.int64)
        for i in range(0, len(at), 200_000):
            part = slice(i, i + 200_000)
            high[part] = word[part] * 64 + select(self.high.reshape(-1, 8)[word[part]], at[part] - before[part]) - at[part]
        return high.astype(np.uint64) << U(self.low_bits) | self.lows(at)


class BigramTrie:
    """Two levels of a trie in mapped arrays: contexts with monotone pointers to their successors, and the successors of
    all contexts, each counted on from its context's base so that the whole level is monotone, with quantised gains."""

    def __init__(self, left: np.ndarray, right: np.ndarray, gains: np.ndarray, levels: Levels):
        """``left, right`` are sorted and distinct as pairs."""
        first = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.empty(0, np.int64)
        self.base = int(right.max()) + 1 if len(right) else 1
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(left))))
        self.contexts = EliasFano(left[first]).mapped(levels)
        self.pointers = EliasFano(np.append(first, len(left))).mapped(levels)
        self.successors = EliasFano(rank * self.base + right).mapped(levels)
        self.codes = levels.put(np.rint(gains * STEP).astype(np.uint16))

    def code(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Codes of the pairs' gains, 0 for pairs that the trie lacks."""
        if not len(self.codes):
            return np.zeros(len(left), np.int64)
        own = np.minimum(self.contexts.successor(left), self.contexts.n - 1)
        known = (self.contexts.get(own).astype(np.int64) == left) & (right < self.base)
        # Context-relative search: the successor of the word inside the range that the context's pointers give.
        begin, end = (self.pointers.get(own + k).astype(np.int64) for k in (0, 1))
        key = own * self.base + np.minimum(right, self.base - 1)
        place = self.successors.successor(key)
        known &= (begin <= place) & (place < end)
        place = np.minimum(place, len(self.codes) - 1)
        known &= self.successors.get(place).astype(np.int64) == key
        return np.where(known, self.codes[place].astype(np.int64), 0)


def positions_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, sizes = split_words(texts)
    return words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), sizes


def number_words(rows: Iterator[tuple[str, int, bytes]], parts: int) -> Iterator[tuple[str, int, bytes]]:
    """Numbers and training counts of the words of each range. Words are numbered in order, so that a task that runs
    again gives the same numbers. A row without a batch tells how many words of the range occur in training."""
    held: dict[int, list[tuple[str, list[str], np.ndarray]]] = {}
    for name, part, data in rows:
        letters, counts = unpack(data)
        held.setdefault(part, []).append((name, letters.tobytes().decode().split("\n"), counts))
    while held:
        part, batches = held.popitem()
        words = sorted({w for _, ws, _ in batches for w in ws})
        place = {w: i for i, w in enumerate(words)}
        total = np.zeros(len(words), np.int64)
        at = [np.fromiter((place[w] for w in ws), np.int64, len(ws)) for _, ws, _ in batches]
        for own, (_, _, counts) in zip(at, batches):
            total[own] += counts
        yield "", part, pack(np.array([np.count_nonzero(total)]))
        for own, (name, _, _) in zip(at, batches):
            yield name, part, pack(small(2 + own * parts + part), small(total[own]))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, mu: float = 300.0, salt: int = SALT, repeated: int = REPEATED) -> DataFrame:
    """Return ``doc_id, held_out, n_tokens, n_known, train_tokens long, base_score, score double`` for every row.

    * null and empty texts have one token, their end; very long texts are scored whole.
    * ``held`` marks the rows that nothing is learned from; repeated rows each count and each give a row.
    * without any training row every count is 0 and ``score`` equals ``base_score``; an empty table gives no rows.
    * null ids are training rows; other columns of the input are not read.
    * ``salt`` and ``repeated`` steer the work only.
    """
    scratch = Scratch(docs.sparkSession)
    held = held_out(F.col(id_col)) if held is None else held
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = parts_for(src)
    dealt = scratch.cut(split(src, parts, positions_of))
    numbered = scratch.cut(answered(dealt.filter("part >= 0"), parts, lambda rows: number_words(rows, parts)))
    texts_in, words_in, distinct = totals(dealt, numbered)
    n_all, norm = words_in + texts_in, float(words_in + texts_in + distinct + bool(texts_in) + 1)

    def deal(ids: pa.Array, own: tuple[np.ndarray, np.ndarray, np.ndarray], found: list[list[np.ndarray]]) -> pa.Table:
        """A row of a batch's texts (part -1), and a row of packed bigrams for each part."""
        sizes, is_held, positions = own
        number, count = (np.concatenate([*(f[k].astype(np.int64) for f in found), np.empty(0, np.int64)]) for k in (0, 1))
        k = len(sizes)
        text = np.repeat(np.arange(k), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(text), bool)
        inner[ends] = False
        w, c = np.full(len(text), END, np.int64), np.full(len(text), texts_in, np.int64)
        w[inner], c[inner] = number[positions], count[positions]
        v, cv = np.append(START, w[:-1]), np.append(texts_in, c[:-1])
        begin = np.append(0, ends[:-1] + 1)
        v[begin], cv[begin] = START, texts_in
        low = np.log10((c + 1) / norm)
        base = np.bincount(text, weights=low, minlength=k)
        away = base + np.bincount(text, weights=np.log10(mu / (cv + mu)), minlength=k)
        known = np.bincount(text, weights=c > 0, minlength=k).astype(np.int64)
        may = np.flatnonzero((c > 0) & (cv > 0))
        turn = mix(w[may].astype(np.uint64)) % (cv[may] // salt + 1).astype(np.uint64)
        part = (mix(v[may].astype(np.uint64) * U(0x9E3779B97F4A7C15) + turn) % U(parts)).astype(np.int64)
        own, at, blobs = dealt_pairs(v[may], w[may], np.rint(-low[may] * STEP).astype(np.uint16), text[may], part, is_held, repeated)
        out = [pack(sizes + 1, known, base, away, is_held, *own), *blobs]
        lists = pa.ListArray.from_arrays(pa.array([0] + [k] * len(out), pa.int32()), ids)
        return pa.Table.from_arrays([pa.array([-1, *at], pa.int32()), pa.array(out, pa.binary()), lists], ["part", "data", "ids"])

    named = with_answers(dealt.filter("part < 0").unionByName(numbered.filter("batch <> ''")), deal, f"part int, data binary, ids array<{kind}>", name=True)
    place = F.when(F.col("part") < 0, F.pmod(F.xxhash64("batch"), F.lit(parts))).otherwise(F.col("part"))
    doc_ids = pa.list_(pa.field("element", to_arrow(src.schema["doc_id"].dataType)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts' rows as they are; for each part its trie, and the sums of codes that its bigrams give to texts."""
        held_blobs: dict[int, list[tuple[str, list[np.ndarray]]]] = {}
        for batch in batches:
            through = [i for i, p in enumerate(batch.column("part").to_pylist()) if p < 0]
            if through:
                yield batch.take(pa.array(through)).select(["batch", "data", "ids"])
            for name, p, data in zip(*(batch.column(x).to_pylist() for x in ("batch", "part", "data"))):
                if p >= 0:
                    held_blobs.setdefault(p, []).append((name, unpack(data)))
        while held_blobs:
            _, blobs = held_blobs.popitem()
            for name, sums in looked_up(blobs, mu):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sums], pa.binary()), pa.nulls(1, doc_ids)], ["batch", "data", "ids"])

    settled = named.repartition(parts, place).mapInArrow(settle, f"batch string, data binary, ids array<{kind}>")

    def finish(rows: pa.Table) -> pa.Table:
        """One batch of texts: its own row, and a row of sums from each part."""
        ids = own = None
        sums = []
        for data, names in zip(rows.column("data"), rows.column("ids")):
            if names.is_valid:
                ids, own = names.values, unpack(data.as_py())
            else:
                sums.append(unpack(data.as_py()))
        n, known, base, away, is_held, *often = own
        total = np.zeros(len(n), np.int64)
        for text, codes, _, _ in sums:
            total[text] += codes
        total += repeated_gains(often, [(x[2], x[3]) for x in sums], len(n))
        return pa.Table.from_arrays(
            [ids, pa.array(is_held.astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(base), pa.array(away + total / STEP)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return settled.groupBy("batch").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def totals(dealt: DataFrame, numbered: DataFrame) -> tuple[int, int, int]:
    """Training texts, training words, and distinct training words; numbers only are collected."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unpack(d)[:2] for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((~h).sum()) for _, h in own], pa.int64()), pa.array([int(s[~h].sum()) for s, h in own], pa.int64())], ["texts", "words"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(d)[0][0]) for d in batch.column("data").to_pylist()], pa.int64())], ["n"])

    a = dealt.filter("part < 0").select("data").mapInArrow(texts, "texts bigint, words bigint").agg(F.sum("texts"), F.sum("words")).first()
    b = numbered.filter("batch = ''").select("data").mapInArrow(words, "n bigint").agg(F.sum("n")).first()
    return a[0] or 0, a[1] or 0, b[0] or 0


def dealt_pairs(v: np.ndarray, w: np.ndarray, code: np.ndarray, text: np.ndarray, part: np.ndarray, is_held: np.ndarray, repeated: int = REPEATED) -> tuple[list[np.ndarray], list[int], list[bytes]]:
    """A batch's bigrams, given in the order of its texts: what the batch keeps of those of ``repeated`` occurrences or more,
    parts, and for each part its bigrams packed. There the rarer ones stand once an occurrence, the others once, with their
    training occurrences and a number by which their gains come back."""
    order = np.lexsort((w, v, part))
    sv, sw, sp = v[order], w[order], part[order]
    new = np.ones(len(order), bool)
    new[1:] = (sp[1:] != sp[:-1]) | (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] >= repeated if len(group) else np.zeros(0, bool)
    heads, loose = np.flatnonzero(new & often), np.flatnonzero(~often)
    learned = np.bincount(group, weights=~is_held[text[order]], minlength=1)[group[heads]].astype(np.int64)
    # The batch's own occurrences of repeated bigrams, by text, with numbers that are small for frequent ones.
    number = np.empty(len(heads), np.int64)
    number[ranks(np.bincount(group, minlength=1)[group[heads]])] = np.arange(len(heads))
    of_group = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
    of_group[group[heads]] = number
    at = np.full(len(order), -1, np.int64)
    at[order[often]] = of_group[group[often]]
    mine = np.flatnonzero(at >= 0)
    own = [small(np.diff(text[mine], prepend=0)), *planes(at[mine], len(heads))]
    parts, blobs = np.unique(sp), []
    edges = [np.append(np.searchsorted(sp[x], parts), len(x)) for x in (loose, heads)]
    for i in range(len(parts)):
        a, b = (x[e[i] : e[i + 1]] for x, e in zip((loose, heads), edges))
        few = [small(np.diff(sv[a], prepend=0)), small(sw[a]), code[order[a]], small(text[order[a]]), is_held]
        more = slice(*edges[1][i : i + 2])
        blobs.append(pack(*few, small(np.diff(sv[b], prepend=0)), small(sw[b]), code[order[b]], small(learned[more]), small(number[more])))
    return own, parts.tolist(), blobs


def repeated_gains(own: list[np.ndarray], answers: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sums of codes of a batch's repeated bigrams for each of its ``n`` texts; numbers without an answer have no gain."""
    steps, *bytes_ = own
    at = sum((b.astype(np.int64) << 8 * k for k, b in enumerate(bytes_)), np.int64(0))
    if not len(steps):
        return np.zeros(n, np.int64)
    codes = np.zeros(int(at.max()) + 1, np.int64)
    for number, code in answers:
        codes[number] = code
    return np.bincount(np.cumsum(steps.astype(np.int64)), weights=codes[at], minlength=n).astype(np.int64)


def looked_up(blobs: list[tuple[str, list[np.ndarray]]], mu: float) -> Iterator[tuple[str, bytes]]:
    """For each batch the texts that have bigrams of this part, the sums of their codes, and numbers and codes of repeated bigrams."""
    sides = [b[i : i + 3] for i in (0, 5) for _, b in blobs]
    left = np.concatenate([np.cumsum(x[0].astype(np.int64)) for x in sides])
    right = np.concatenate([x[1].astype(np.int64) for x in sides])
    low = np.concatenate([x[2] for x in sides])
    learn = np.concatenate([*(~b[4][b[3]] for _, b in blobs), *(b[8] for _, b in blobs)]).astype(np.float64)
    order = np.lexsort((right, left))
    left, right, low = left[order], right[order], low[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    seen = np.bincount(which, weights=learn, minlength=len(first))
    left, right, low = left[first], right[first], low[first]
    had = seen > 0
    gains = np.log10(1 + seen[had] * 10 ** (low[had] / STEP) / mu)
    with Levels() as levels:
        codes = BigramTrie(left[had], right[had], gains, levels).code(left, right)[which]
    at, more = 0, sum(len(b[0]) for _, b in blobs)
    for name, b in blobs:
        sums = np.bincount(b[3], weights=codes[at : at + len(b[0])], minlength=1).astype(np.int64)
        own = codes[more : more + len(b[5])]
        at, more = at + len(b[0]), more + len(b[5])
        texts, some = np.flatnonzero(sums), np.flatnonzero(own)
        yield name, pack(small(texts), small(sums[texts]), b[9][some], small(own[some]))


def to_arrow(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)

"""Periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q and length of at least 2 q that cannot be extended. Every run holds the longest
Lyndon word of one of its places, under one of two opposite orders of the words (Bannai et al., *The "Runs" Theorem*), so two
candidates a place are all there is to try. For the texts of a batch at once:

* suffixes are sorted by doubling, where only suffixes that still tie are sorted again; texts share no word numbers, so they never mix;
* the longest Lyndon word at a place ends before the next smaller value of the inverse suffix array, and under the opposite
  order (in which the end of a text is the largest word) before the next greater one;
* common extensions of a root to the right and to the left come from the LCP arrays of the words and of the reversed words, by
  range minima from a sparse table whose levels are made one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import give_back
from trivet.llm.shingles import batches_of

BATCH_CHARS = 1_500_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` as they are, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    flat = lists.flatten()
    solid = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.cumsum(np.append(0, solid.to_numpy(zero_copy_only=False)))
    edges = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return flat.filter(solid).dictionary_encode(), np.diff(ends[edges])


def suffix_ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``x`` and its inverse; the end is smaller than every number."""
    n = len(x)
    sa = np.argsort(x, kind="stable")
    new = np.append(True, x[sa[1:]] != x[sa[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 1
    while len(tied):
        at = sa[tied]
        order = np.argsort(rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1, kind="stable")
        at = at[order]  # groups keep their places: they are sorted by rank already
        sa[tied] = at
        first, second = rank[at], rank[np.minimum(at + h, n)]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank[:n]


def common(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes at ``i`` and ``j`` share, by comparison."""
    padded = np.append(x, [-1] * 33)
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(32):
        live = live[(padded[i[live] + k] == padded[j[live] + k]) & (np.maximum(i[live], j[live]) + k < len(x))]
        if not len(live):
            return out
        out[live] = k + 1
    for p in live.tolist():  # few: long repeats
        a, b, k, width = int(i[p]), int(j[p]), 32, 64
        while True:
            width = min(width, len(x) - max(a, b) - k)
            differ = np.flatnonzero(x[a + k : a + k + width] != x[b + k : b + k + width])
            if len(differ) or width <= 0:
                out[p] = k + (int(differ[0]) if len(differ) else 0)
                break
            k, width = k + width, width * 2
    return out


def lcp_array(x: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """``lcp[r]`` numbers are shared by the suffixes of ranks r - 1 and r. Only irreducible values are compared: where the
    numbers before both suffixes are equal, the value is that of the place before less one."""
    n = len(x)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = (place > 0) & (before > 0)
    reducible[reducible] = x[place[reducible] - 1] == x[before[reducible] - 1]
    whole = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    pairs = whole[before[whole] >= 0]
    value[pairs] = common(x, pairs, before[pairs])
    last = np.maximum.accumulate(np.where(reducible, 0, place))
    return (value[last] - (place - last))[sa]


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``values[lo..hi]`` (both included, ``lo <= hi``) by a sparse table, one level in memory at a time."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    by_level = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by_level], np.arange(int(level.max(initial=0)) + 2))
    out, row = np.empty(len(lo), np.int64), values
    for k in range(len(edges) - 1):
        if k:
            row = np.minimum(row[: -(1 << k - 1)], row[1 << k - 1 :])
        own = by_level[edges[k] : edges[k + 1]]
        out[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << k) + 1])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place to the right of each place with a smaller value, else the length; values are distinct and not negative."""
    n = len(values)
    size = 1 << int(n).bit_length()
    tree = np.full(2 * size, np.iinfo(np.int64).max)
    tree[size : size + n] = values
    tree[size + n] = -1  # found by all
    for k in range(size.bit_length() - 1, 0, -1):
        row = tree[1 << k : 2 << k]
        tree[1 << k - 1 : 1 << k] = np.minimum(row[::2], row[1::2])
    out, live = np.empty(n, np.int64), np.arange(n)
    at, want = live + size + 1, values
    while len(live):  # up, where nothing below is smaller
        below = tree[at] < want
        found, at_found, want_found = live[below], at[below], want[below]
        while len(found):  # down, to the first smaller one
            inner = at_found < size
            out[found[~inner]] = at_found[~inner] - size
            found, at_found, want_found = found[inner], at_found[inner] * 2, want_found[inner]
            at_found += tree[at_found] >= want_found
        live, at, want = live[~below], at[~below] + 1, want[~below]
        at = np.where(at % 2 == 0, at >> 1, at)
    return out


class Extensions:
    """Common prefixes of any two suffixes."""

    def __init__(self, x: np.ndarray, sa: np.ndarray, rank: np.ndarray):
        self.rank, self.lcp = rank, lcp_array(x, sa)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b))


def runs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of many texts: text, start, length and period, in order of text, start and period. ``words`` holds the texts'
    word numbers one after the other, ``counts`` how many each text has."""
    texts = np.repeat(np.arange(len(counts)), counts)
    n = len(words) + len(counts) + 1  # a zero before, between and after the texts
    place = np.arange(len(words)) + texts + 1
    x, owner = np.zeros(n, np.int64), np.repeat(np.arange(len(counts) + 1), np.append(1, counts + 1)) - 1
    if len(words):
        x[place] = texts * (int(words.max()) + 1) + words + 1
    sa, rank = suffix_ranks(x)
    found = []
    for order in (rank, n - 1 - rank):
        end = next_smaller(order)[place]
        inside = (end < n) & (owner[np.minimum(end, n - 1)] == texts)
        i, j = place[inside], end[inside]
        near = (x[i] == x[j]) | (x[i - 1] == x[j - 1])  # else the root is extended on neither side
        found.append((i[near], j[near]))
    i, j = (np.concatenate(side) for side in zip(*found))
    right, left = Extensions(x, sa, rank).of(i, j), np.zeros(len(i), np.int64)
    back = np.flatnonzero(x[i - 1] == x[j - 1])
    if len(back):
        mirrored = x[::-1].copy()
        left[back] = Extensions(mirrored, *suffix_ranks(mirrored)).of(n - i[back], n - j[back])
    period = j - i
    good = left + right >= period
    text = owner[i[good]]
    first = np.append(0, np.cumsum(counts + 1)[:-1]) + 1 if len(counts) else np.empty(0, np.int64)
    rows = np.stack([text, i[good] - left[good] - first[text], (period + left + right)[good], period[good]], 1)
    rows = np.unique(rows[:, [0, 1, 3, 2]], axis=0) if len(rows) else rows
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def kept_words(total: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period; starts are places among all words."""
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, starts + periods, 1)
    np.add.at(cover, starts + lengths, -1)
    return np.cumsum(cover)[:total] == 0


def find_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, n_words long, runs array<struct<start, length, period>>, collapsed string`` for every row: runs with at
    least ``least_length`` words and ``least_exponent`` periods (2 or more), by start and period, and the text without the words
    that repeat a run's first period, joined by one space. One narrow pass, no shuffle.

    * null and empty texts and texts of white space have no words, no runs and an empty ``collapsed``.
    * runs may overlap; of equal starts the shorter period comes first; a text is read whole, about 150 bytes a word of it.
    * repeated rows each give a row, ids may be null, other columns are not read, an empty table gives no rows.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in batches_of((t.as_py() for t in batch.column("text")), BATCH_CHARS):
                yield answer(texts, batch.column("doc_id").slice(at, len(texts)))
                at += len(texts)
        give_back()

    def answer(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
        words, counts = words_of(texts)
        text, start, length, period = runs_of(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        good = (length >= least_length) & (length >= least_exponent * period)
        text, start, length, period = text[good], start[good], length[good], period[good]
        first = np.append(0, np.cumsum(counts))
        keep = kept_words(len(words), first[text] + start, length, period)
        ends = np.append(0, np.cumsum(keep))[first]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.dictionary.take(words.indices.filter(pa.array(keep))))
        each = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], ["start", "length", "period"])
        edges = np.append(0, np.cumsum(np.bincount(text, minlength=len(texts))))
        runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each)
        return pa.RecordBatch.from_arrays([ids, pa.array(counts), runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where every tenth document by print repeats itself from some word on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        unit = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        many = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), many), F.lit(1), n.cast("int")), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)))[0]
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull(), F.coalesce(changed, F.col("text"))).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """The runs of ``planted`` documents as counts, the run of most periods, and digests. A null id's print is null, so its text is
    left as it is."""
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = find_runs(planted(docs)).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

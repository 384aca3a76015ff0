"""Words and word shingles of whole texts, computed for many texts at once.

A word is known by 128 bits of SipHash (two keys) over its letters, a shingle by 128 bits mixed from those of its words: two lanes of
64 bits. The first lane is what texts are searched by; both lanes decide whether two shingles are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

KEYS = ("trivet word lane", "trivet word side")
U = np.uint64
Lanes = tuple[np.ndarray, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(texts: list[str] | pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each distinct one once, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())))
    flat = lists.flatten()
    solid = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.cumsum(np.append(0, solid.to_numpy(zero_copy_only=False)))
    edges = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return flat.filter(solid).dictionary_encode(), np.diff(ends[edges])


def prints_of(words: pa.Array) -> Lanes:
    """Both lanes of each word."""
    each = words.to_numpy(zero_copy_only=False)
    return tuple(hash_array(each, hash_key=key, categorize=False) if len(each) else np.empty(0, np.uint64) for key in KEYS)


def word_prints(texts: list[str] | pa.Array) -> tuple[Lanes, np.ndarray]:
    """Both lanes of every word of the texts, and each text's number of words."""
    words, counts = words_of(texts)
    a, b = prints_of(words.dictionary)
    at = words.indices.to_numpy()
    return (a[at], b[at]), counts


def _chain(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A print of each run of ``size`` words."""
    n = max(len(words) - size + 1, 0)
    out = np.full(n, seed * 0x9E3779B97F4A7C15 + size & (1 << 64) - 1, np.uint64)
    for j in range(size):
        out = mix((out ^ words[j : j + n]) * U(0xD1342543DE82EF95) + U(0x2545F4914F6CDD1D))
    return out


def shingle_sets(texts: list[str] | pa.Array, size: int = 5) -> Iterator[Lanes]:
    """For each text its distinct shingles of ``size`` words, in order; with fewer words the whole sequence is one shingle,
    without words there is none."""
    lanes, counts = word_prints(texts)
    runs = [_chain(lane, size, seed) for seed, lane in enumerate(lanes, 1)]
    at = 0
    for k in counts.tolist():
        if k >= size:
            a, b = (run[at : at + k - size + 1] for run in runs)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            same = a[1:] == a[:-1]
            if same.any():
                if (b[1:] != b[:-1])[same].any():  # two shingles share the first lane
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                new = np.append(True, ~same)
                a, b = a[new], b[new]
            yield a, b
        else:
            yield tuple(_chain(lane[at : at + k], k, seed) if k else np.empty(0, np.uint64) for seed, lane in enumerate(lanes, 1))
        at += k


def set_print(shingles: Lanes) -> bytes:
    """A 128-bit print of a set."""
    return blake2b(shingles[0].tobytes() + shingles[1].tobytes(), digest_size=16).digest()


class Index:
    """Sets as one inverted list: entries sorted by the first lane, each with its set."""

    def __init__(self, sets: list[Lanes]):
        self.sizes = np.array([len(a) for a, _ in sets], np.int64)
        a, b = (np.concatenate([*(s[lane] for s in sets), np.empty(0, np.uint64)]) for lane in (0, 1))
        order = np.argsort(a, kind="stable")
        self.a, self.b, self.owner = a[order], b[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, shingles: Lanes) -> np.ndarray:
        """How many of the shingles each set holds, by binary probes."""
        a, b = shingles
        lo, hi = np.searchsorted(self.a, a, "left"), np.searchsorted(self.a, a, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = at[self.b[at] == np.repeat(b, n)]
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def batches_of(texts: Iterable[str], chars: int = 1_000_000, rows: int = 2_000) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text stands alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and (size + len(text) > chars or len(held) >= rows):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held

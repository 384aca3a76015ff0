"""Token counts by a vocabulary: greedy longest match in a trie."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_PIECES = 1_000_000
END = ""


def trie(pieces: Iterable[str]) -> dict:
    """Nested maps of letters; a piece ends where the empty key is."""
    root: dict = {}
    for n, piece in enumerate(pieces):
        if n >= MOST_PIECES:
            raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        if piece:
            node[END] = True
    return root


def count(root: dict, text: str) -> int:
    """Pieces of the longest match from left to right; a letter that begins none counts as one."""
    n, at, size = 0, 0, len(text)
    while at < size:
        node, i, end = root, at, at + 1
        while i < size and (node := node.get(text[i])) is not None:
            i += 1
            if END in node:
                end = i
        n, at = n + 1, end
    return n


def counter(spark: SparkSession, pieces: Iterable[str]) -> Callable[[Column], Column]:
    """A function of a text column: its number of tokens (null: 0), as bigint. The trie is shared with all workers; it is of the
    vocabulary's size, :data:`MOST_PIECES` pieces at most."""
    shared = spark.sparkContext.broadcast(trie(pieces))

    def tokens(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root = shared.value
        for column in columns:
            yield pd.Series([0 if x is None else count(root, x) for x in column], dtype="int64")

    return F.pandas_udf(tokens, "bigint")

"""Distinct words of batches of texts, dealt to ranges of words, worked on there, and joined back by position.

A batch is a run of texts with its distinct words and, for every position, the number of its word. The words move, once for
each batch, to the range that their hash names; what is found there for each word comes back to the batch, where positions
take it. So texts never move, a frequent word costs one entry a batch, and no list of words is in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import give_back
from trivet.llm.shingles import U, batches_of

BATCH_CHARS = 3_000_000
PART_BYTES = 8 << 20  # text for each range of words
KEY = "trivet word part"
_KINDS = ["<u1", "<u2", "<u4", "<u8", "<i2", "<i4", "<i8", "<f8", "|u1", "|b1"]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed text."""
    head = np.array([len(arrays), *[x for a in arrays for x in (_KINDS.index(a.dtype.str), len(a))]], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for kind, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, _KINDS[kind], size, at))
        at += out[-1].nbytes
    return out


def small(values: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the fewest bytes that hold them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def joined(words: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(words).encode(), np.uint8)


def parts_for(src: DataFrame) -> int:
    """Ranges by the size of the texts; a shuffle of more than 2**17 would have tasks without work to do."""
    n_bytes = src.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    return min(max(16, n_bytes // PART_BYTES), 1 << 17)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Places by falling count: frequent words get small numbers, which pack well."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def planes(numbers: np.ndarray, top: int) -> list[np.ndarray]:
    """Bytes of numbers up to ``top``, low ones first, each in an array of its own."""
    return [(numbers >> 8 * k).astype(np.uint8) for k in range(max(1, -(-top.bit_length() // 8)))]


def runs_of(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[str], np.ndarray, pa.Array]]:
    """Texts, flags and ids of about ``chars`` characters, across the batches of rows that come in."""
    texts: list[str] = []
    flags, ids, size = [], [], 0

    def out() -> tuple[list[str], np.ndarray, pa.Array]:
        return texts, np.concatenate(flags).astype(np.bool_), pa.concat_arrays(ids)

    for batch in batches:
        held, at = batch.column("held_out").to_numpy(zero_copy_only=False), 0
        for part in batches_of((x.as_py() for x in batch.column("text")), chars, rows=1 << 30):
            n = sum(map(len, part))
            if texts and size + n > chars:
                yield out()
                texts, flags, ids, size = [], [], [], 0
            texts, size = texts + part, size + n
            flags.append(held[at : at + len(part)])
            ids.append(batch.column("doc_id").slice(at, len(part)))
            at += len(part)
    if texts:
        yield out()


def split(src: DataFrame, parts: int, words_of: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], chars: int = BATCH_CHARS) -> DataFrame:
    """``batch, part, data, ids`` of texts (``doc_id, text, held_out``). A batch's own row has part -1, the ids of
    its texts, and packed words of each text, flags, words of each part, counts and positions; the others have packed
    words and their counts in texts that are not held out. ``words_of`` gives the distinct words of texts, every position's
    word by number, and each text's number of words. Words hold no line break."""
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (texts, held, ids) in enumerate(runs_of(batches, chars)):
            words, positions, sizes = words_of(texts)
            names = np.array(words, object)
            part = (hash_array(names, hash_key=KEY, categorize=False) % U(parts)).astype(np.int64) if words else np.empty(0, np.int64)
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # neighbours pack well
            order = order[np.argsort(part[order], kind="stable")]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = place[positions]
            counts = np.bincount(at, minlength=len(words))
            seen = np.bincount(at[~np.repeat(held, sizes)], minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[ranks(counts)] = np.arange(len(words))
            own, starts = np.unique(part[order], return_index=True)
            edges = np.append(starts, len(order))
            data = [pack(small(sizes), held, small(np.diff(edges)), small(counts), *planes(rank[at], len(words)), level=3)]
            for a, b in zip(edges[:-1], edges[1:]):
                data.append(pack(joined(names[order[a:b]].tolist()), small(seen[a:b]), level=9))
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(data), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}:{number}"] * len(data)), pa.array([-1, *own.tolist()], pa.int32()), pa.array(data, pa.binary()), lists], ["batch", "part", "data", "ids"])
        give_back()

    return src.mapInArrow(run, f"batch string, part int, data binary, ids array<{kind}>")


def answered(dealt: DataFrame, parts: int, answer: Callable[[Iterator[tuple[str, int, bytes]]], Iterator[tuple[str, int, bytes]]]) -> DataFrame:
    """``batch, part, data, ids``: what ``answer`` makes of the words of each range, a row for each batch's words. Batches'
    own rows, where ``dealt`` has them, pass by."""
    ids = dealt.schema["ids"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        own: list[pa.RecordBatch] = []

        def words() -> Iterator[tuple[str, int, bytes]]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema
                parts_ = batch.column("part").to_pylist()
                if min(parts_) < 0:
                    own.append(batch.filter(pa.array([p < 0 for p in parts_])))
                for name, part, data in zip(batch.column("batch").to_pylist(), parts_, batch.column("data").to_pylist()):
                    if part >= 0:
                        yield name, part, data
                    elif own:
                        yield "", -1, b""  # gives way to the batches' own rows

        for name, part, data in answer(words()):
            while own:
                yield own.pop()
            if part >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, kind.field("ids").type)], schema=kind)
        while own:
            yield own.pop()
        give_back()

    place = F.when(F.col("part") < 0, F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    return dealt.repartition(parts, place).mapInArrow(run, f"batch string, part int, data binary, ids {ids.simpleString()}")


def positions_in(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, flags, and positions, of a batch's own row; words are counted through its parts."""
    sizes, held, _, counts, *bytes_ = own
    numbers = sum((b.astype(np.int64) << 8 * k for k, b in enumerate(bytes_)), np.int64(0))
    return sizes.astype(np.int64), held.astype(np.bool_), ranks(counts)[numbers] if len(counts) else np.empty(0, np.int64)


def with_answers(both: DataFrame, finish: Callable[[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray], list[list[np.ndarray]]], pa.Table], schema: str, name: bool = False) -> DataFrame:
    """What ``finish`` makes of each batch from its own row and its answers: it takes the batch's ids, what
    :func:`positions_in` gives, and the arrays of the answers by part; with ``name`` the batch's name stands before."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy())
        first = int(order[0])
        data = rows.column("data")
        ids = rows.column("ids")[first].values
        out = finish(ids, positions_in(unpack(data[first].as_py())), [unpack(data[int(i)].as_py()) for i in order[1:]])
        give_back()
        return out.add_column(0, "batch", pa.array([rows.column("batch")[0].as_py()] * out.num_rows)) if name else out

    return both.groupBy("batch").applyInArrow(run, f"batch string, {schema}" if name else schema)

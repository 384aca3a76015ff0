"""Token counts by compiled finite-state transducers.

Two deterministic transducers read a text. The first splits it into the pieces that merges never cross; it runs over
fixed-size chunks of characters from every state at once, the resulting state maps compose by a parallel prefix scan, and
only then is each chunk run again from its true state. The second reads a piece byte by byte; its transitions carry the
change in the number of emitted tokens, so a piece's count is the sum along its path. It is compiled lazily: for every
prefix there is exactly one last token that may follow the last token of the rest, which is all a transition needs. Its
states are the prefixes, as many as there are pieces, so it has no table of all state maps to compose: the scan gives the
pieces' borders, equal pieces of many texts (told apart by their bytes) run once, and texts add up their pieces' counts.

A task keeps the transducer and the counts of recent pieces across batches, within bounds; a piece of any length runs in a
window of states as long as the longest token. Counts never depend on what is kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128
GROUP_CHARS = 1_000_000
MAX_STATES = 600_000
RECENT = 300_000  # pieces whose counts are kept
#: Between a letter and a space before a letter a piece ends, whatever stands around.
BORDER = re.compile("[a-z](?= [a-z])")

# Character classes. Letters that contractions need stand apart; BREAK parts texts from each other.
L, STMD, R, V, E, LL, N, O, QUOTE, SPACE, WHITE, BREAK = range(12)
LETTERS = (L, STMD, R, V, E, LL)
#: Unicode white space. Fixed values.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States: fresh (a piece has ended), in a run of letters, numbers or others, in white space ending in a space or not,
# after a quote that began a piece, and after such a quote with r, v or l.
FRESH, IN_L, IN_N, IN_O, IN_S, IN_W, Q, QR, QV, QL = range(10)
HERE, BEFORE = 1, 2  # emitted: a piece begins at this character, at the one before


def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110001, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = L
        elif kind == "N":
            out[c] = N
    out[WHITE_SPACE] = WHITE
    for text, cls in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", LL), ("'", QUOTE), (" ", SPACE)):
        out[[ord(c) for c in text]] = cls
    out[0x110000] = BREAK
    return out


def piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission of every (state, class), flat."""
    to, emit = np.zeros((10, 12), np.uint8), np.zeros((10, 12), np.uint8)
    for state in range(10):
        for cls in range(12):
            run = IN_L if cls in LETTERS else {N: IN_N, O: IN_O, QUOTE: IN_O, SPACE: IN_S, WHITE: IN_W, BREAK: FRESH}[cls]
            out = HERE
            if cls == QUOTE and state != IN_O and state != IN_S:
                run = Q  # at its start only, a piece may be a contraction
            if state == run and cls != BREAK and run in (IN_L, IN_N, IN_O) or state in (IN_S, IN_W) and run in (IN_S, IN_W):
                out = 0
            elif state in (IN_S, IN_W) and cls != BREAK:
                out = BEFORE | (HERE if state == IN_W else 0)  # the last white space parts from those before it
            elif state == Q:
                if cls == STMD:
                    run, out = FRESH, 0
                elif cls in (R, V, LL):
                    run, out = {R: QR, V: QV, LL: QL}[cls], 0
                elif cls in (O, QUOTE):
                    run, out = IN_O, 0
            elif (state, cls) in ((QR, E), (QV, E), (QL, LL)):
                run, out = FRESH, 0
            elif state in (QR, QV, QL):
                out = BEFORE | (0 if run == IN_L else HERE)  # no contraction: the letter began a piece
            to[state, cls], emit[state, cls] = run, out
    return to.ravel(), emit.ravel()


def piece_starts(classes: np.ndarray, to: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character. ``classes`` ends with BREAK."""
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, BREAK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(10, dtype=np.uint8)[:, None], rows, axis=1)  # state map of each chunk, from every state
    scaled = to * np.uint8(12)
    maps *= 12
    for step in range(CHUNK):
        maps = scaled[maps + grid[step]]
    maps //= 12
    d = 1
    while d < rows:  # prefix scan: after it, a chunk's map leads from the text's start to the chunk's end
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d], axis=0)
        d *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = maps[FRESH, :-1]
    state *= 12
    out = np.empty((CHUNK, rows), np.uint8)
    for step in range(CHUNK):
        at = state + grid[step]
        out[step] = emit[at]
        state = scaled[at]
    flat = out.T.ravel()[:n]
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return starts


class PieceCounts:
    """The second transducer. A state is a prefix; ``count`` and ``last`` are its number of tokens and its last token."""

    def __init__(self, vocab: dict[bytes, int], parts: dict[int, tuple[int, int]], merges: dict[tuple[int, int], int], most: int = MAX_STATES):
        self.vocab, self.parts, self.merges, self.most = vocab, parts, merges, most
        self.recent: dict[bytes, int] = {}
        self.longest = max(map(len, vocab))
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.edges: dict[int, int] = {}
        self.count, self.last, self.up = [0], [-1], [0]

    def rebase(self, node: int) -> int:
        """Forget all states but those that the next transitions from ``node`` can look at, which are then of this piece
        only. Place 1 stands for what lies before them and is never looked at."""
        chain = [node]
        while len(chain) < self.longest:
            chain.append(self.up[chain[-1]])
        count, last = ([values[k] for k in reversed(chain)] for values in (self.count, self.last))
        self.edges = {}
        self.count, self.last, self.up = [0, 0, *count], [-1, -1, *last], [0, 1, *range(1, len(chain) + 1)]
        return len(chain) + 1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` apart when they meet: undo the latest merge of the two again
        and again, and see that no merge across the border would have come before it."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        merges, parts = self.merges, self.parts
        a, b, limit = left, right, 1 << 31
        fits = True
        while True:
            across = merges.get((a, b))
            if across is not None and across < limit:
                fits = False
                break
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                # `a` was made by its merge before the pair could meet: an equal rank on the left comes first.
                a, limit = pa_[1], a
            else:
                b, limit = pb[0], b + 1
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def compile(self, node: int, prefix: bytes) -> int:
        """The state after ``prefix``, whose all but last byte lead to ``node``."""
        back, end = node, len(prefix)
        for size in range(1, min(end, self.longest) + 1):
            token = self.vocab.get(prefix[end - size :])
            if token is not None and (back == 0 or self.may_follow(self.last[back], token)):
                self.count.append(self.count[back] + 1)
                self.last.append(token)
                self.up.append(node)
                return len(self.up) - 1
            back = self.up[back]
        raise ValueError("no token ends this prefix")

    def __call__(self, piece: bytes) -> int:
        known = self.recent.get(piece)
        if known is not None:
            return known
        node, rebased = 0, False
        for i, byte in enumerate(piece):
            key = node << 8 | byte
            to = self.edges.get(key)
            if to is None:
                to = self.edges[key] = self.compile(node, piece[max(0, i + 1 - self.longest) : i + 1])
                if len(self.up) > self.most and i >= self.longest:
                    to, rebased = self.rebase(to), True
            node = to
        n = self.count[node]
        if rebased or len(self.up) > self.most:
            self.reset()
        if len(self.recent) > RECENT:
            self.recent.clear()
        if len(piece) <= self.longest:
            self.recent[piece] = n
        return n


def load(path: str) -> dict:
    """The tables of a byte-level BPE file: tokens as bytes, and what each merge joins."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(keep)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    # A token's rank is the place of the merge that makes it; single bytes come before all.
    ranks = {bytes([b]): b for b in range(256)}
    parts, merges = {}, {}
    for k, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
        a, b = (bytes(byte_of[c] for c in t) for t in (x, y))
        new = ranks.setdefault(a + b, 256 + k)
        parts.setdefault(new, (ranks[a], ranks[b]))
        merges[ranks[a], ranks[b]] = new
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return {"vocab": {t: r for t, r in ranks.items() if t in vocab}, "parts": parts, "merges": merges, "special": special, "classes": char_classes()}


_LIVE: dict[str, tuple] = {}


def transducers(key: str, tables: dict) -> tuple:
    """This worker's transducers."""
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = (*piece_transducer(), PieceCounts(tables["vocab"], tables["parts"], tables["merges"]))
    return _LIVE[key]


def count_group(texts: list[str], tables: dict, to: np.ndarray, emit: np.ndarray, counts: PieceCounts) -> list[int]:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        segments = split_special(text, tables["special"])
        out[i] = len(segments) - 1
        parts += segments
        owner += [i] * len(segments)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1)  # a BREAK after each segment
    codes = np.full(int(ends[-1]), 0x110000, np.uint32)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    whole = "".join(parts)
    codes[inside] = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(piece_starts(tables["classes"][codes], to, emit))
    starts = starts[codes[starts] != 0x110000]
    if not len(starts):
        return out.tolist()
    # Pieces as slices of the UTF-8 bytes; equal ones are found by their bytes.
    n_bytes = np.where(inside, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 0)
    at = np.cumsum(n_bytes) - n_bytes
    raw = whole.encode("utf-8", "surrogatepass")
    offsets = np.append(at[starts], len(raw)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    each = np.fromiter(map(counts, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
    text_of = np.asarray(owner)[np.searchsorted(ends, starts, side="right")]
    return (out + np.bincount(text_of, weights=each[pieces.indices.to_numpy()], minlength=len(texts)).astype(np.int64)).tolist()


def slices(text: str, chars: int) -> Iterator[str]:
    """A long text cut between pieces, into parts of about ``chars`` characters."""
    at = 0
    while len(text) - at > chars and (border := BORDER.search(text, at + chars)):
        yield text[at : border.end()]
        at = border.end()
    yield text[at:]


def counts_of(texts: Iterable[str], tables: dict, live: tuple, chars: int = GROUP_CHARS) -> Iterator[int]:
    """Tokens of each text; long texts are counted slice by slice."""
    for group in groups(texts, chars):
        if len(group) == 1 and len(group[0]) > chars:
            cut_at = [s for segment in split_special(group[0], tables["special"]) for s in slices(segment, chars)]
            specials = len(split_special(group[0], tables["special"])) - 1
            yield specials + sum(count_group([s], tables, *live)[0] for s in cut_at)
        else:
            yield from count_group(group, tables, *live)


def split_special(text: str, special: list[str]) -> list[str]:
    """The stretches between special tokens' strings."""
    out = [text]
    for s in special:
        out = [x for part in out for x in part.split(s)]
    return out


def groups(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text stands alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Return ``doc_id, n_bytes long, n_tokens long, over_limit boolean`` for every row; one narrow pass, no shuffle.

    * null and empty texts have no tokens; repeated rows each give a row; an empty table gives no rows.
    * a special token's string inside a text is that one token; very long texts are counted whole.
    * ids may be null; other columns of the input are not read. What is broadcast is the tokenizer file's content.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        live = transducers(tokenizer_path, tables)
        for batch in batches:
            texts = batch.column("text")
            counts = list(counts_of(texts.to_pylist(), tables, live))
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = src.schema["doc_id"].dataType.simpleString()
    counted = src.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Secret scans through nested encodings by a decoding worklist.

A text is the first layer. Every layer is searched for secrets and for stretches that are encoded: percent escapes, Unicode and
byte escapes, base64 (also URL-safe, over several lines, of UTF-16), and streams of gzip, zlib, bzip2, xz and zstd inside any of these.
What a stretch holds is a layer of its own and goes to the worklist, until nothing new comes. A layer that was seen with the same
content at the same place is not opened again, so an archive of itself ends. Each layer knows the way back: spans are those of the text.
"""

from __future__ import annotations

import bz2
import lzma
import re
import zlib
from binascii import a2b_base64
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import give_back

# fixed values: the kinds of secrets that are searched for, in order, with the least length of what counts
KINDS: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs of 16 or more: shorter ones never count
}
# end of fixed values
RANK = {kind: i for i, kind in enumerate(KINDS)}
#: Characters of unpacked streams that one text may hold; a stream beyond it is counted as unopened, not searched.
MOST_UNPACKED = 64_000_000
SHORTEST = 16  # characters of base64
READABLE = 0.9  # share of printable characters of decoded text

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*={0,2}")
PARTS = (re.compile(r"[^\r\n]+"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9]{16,}={0,2}"))
_STANDARD = str.maketrans("-_", "+/")
UNREADABLE = re.compile(r"[^\x09\x0A\x0D\x20-\x7E\xA0-\U0010FFFF]")

Back = Callable[[int, int], tuple[int, int]]


def secrets_in(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets of a text as it stands: leftmost, non-overlapping for each kind."""
    for kind, (pattern, group, least) in KINDS.items():
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


@dataclass
class Layer:
    """A text, how it came about, the way back to the whole text, and which of its characters were decoded (None: all)."""

    text: str
    how: tuple[str, ...]
    back: Back
    decoded: Pieces | None = None


@dataclass
class Pieces:
    """A text with decoded pieces put in: where each stands in the new text and in the one before."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    old_starts: list[int] = field(default_factory=list)
    old_ends: list[int] = field(default_factory=list)

    def add(self, start: int, size: int, old_start: int, old_end: int) -> None:
        for column, value in zip((self.starts, self.ends, self.old_starts, self.old_ends), (start, start + size, old_start, old_end)):
            column.append(value)

    def _place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.starts, at) - 1
        if k >= 0 and at < self.ends[k]:
            return self.old_starts[k], self.old_ends[k]
        old = at + (self.old_ends[k] - self.ends[k] if k >= 0 else 0)
        return old, old + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]

    def touched(self, start: int, end: int) -> bool:
        """Whether a span holds a decoded character, or ends or begins beside one."""
        k = bisect_right(self.starts, end) - 1
        return k >= 0 and self.ends[k] >= start


def put_in(text: str, found: Iterator[tuple[int, int, str]]) -> tuple[str, Pieces]:
    """Replace stretches by what they stand for."""
    out, pieces, at, size = [], Pieces(), 0, 0
    for start, end, new in found:
        out += [text[at:start], new]
        size += start - at
        pieces.add(size, len(new), start, end)
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), pieces


def percent_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """Characters of percent escapes in UTF-8; bytes that are none stay escaped."""
    for m in PERCENT.finditer(text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            bad = "\udc80" <= c <= "\udcff"
            width = 3 * (1 if bad else len(c.encode()))
            if not bad:
                yield at, at + width, c
            at += width


def escape_pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """Characters of Unicode and byte escapes and numeric references; halves of surrogate pairs are joined."""
    half: tuple[int, int, int] | None = None
    for m in ESCAPE.finditer(text):
        code = int(m[m.lastindex], 10 if m.lastindex == 5 else 16)
        if half and half[1] == m.start() and 0xDC00 <= code < 0xE000:
            yield half[0], m.end(), chr(0x10000 + (half[2] - 0xD800 << 10) + code - 0xDC00)
            half = None
            continue
        half = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            yield m.start(), m.end(), chr(code)


def readable(raw: bytes) -> tuple[str, str] | None:
    """Bytes as text and its encoding, if they are text."""
    encoding = "utf-8" if raw[1::2].count(0) * 3 < len(raw) else "utf-16-le"
    try:
        text = raw.decode(encoding)
    except UnicodeDecodeError:
        return None
    return (text, encoding) if text and len(UNREADABLE.findall(text)) <= (1 - READABLE) * len(text) else None


def stream_of(raw: bytes) -> tuple[str, Callable[[], object]] | None:
    """The kind of a compressed stream by its first bytes, and what unpacks it."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip", lambda: zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 <= 7 and (raw[0] * 256 + raw[1]) % 31 == 0 and not raw[1] & 32:
        return "zlib", lambda: zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor
    if raw[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


def unpacked(raw: bytes, most: int) -> tuple[str, bytes] | None:
    """The kind and the content of a compressed stream, nothing if it is none or broken. OverflowError beyond ``most`` bytes."""
    kind = stream_of(raw)
    if kind is None:
        return None
    out, size, opener, at = [], 0, kind[1](), 0
    try:
        while at < len(raw) and not getattr(opener, "eof", False):
            piece = raw[at : at + 1024]  # it unpacks to about a megabyte at most
            out.append(opener.decompress(piece))
            size += len(out[-1])
            at += len(piece)
            if size > most:
                raise OverflowError
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return None
    return (kind[0], b"".join(out)) if size else None


def base64_bytes(chars: str) -> bytes | None:
    """The bytes of a stretch of base64 without line breaks; nothing where no such stretch can end."""
    chars = chars.rstrip("=").translate(_STANDARD)
    if len(chars) % 4 == 1:
        return None
    return a2b_base64(chars + "=" * (-len(chars) % 4))


class Scan:
    """The worklist of one text."""

    def __init__(self, text: str, most: int = MOST_UNPACKED):
        self.left, self.unopened, self.layers = most, 0, 0
        self.seen: set[tuple[bytes, int, int]] = set()
        self.spans: dict[tuple[str, int, int], str] = {}
        self.work = [Layer(text, (), lambda start, end: (start, end), Pieces())]
        while self.work:
            self.open(self.work.pop())

    def open(self, layer: Layer) -> None:
        self.layers += 1
        for kind, start, end in secrets_in(layer.text):
            if layer.how and layer.decoded is not None and not layer.decoded.touched(start, end):
                continue  # found in the layer before
            self.spans.setdefault((kind, *layer.back(start, end)), ">".join(layer.how))
        for how, pieces in (("url", percent_pieces), ("unicode", escape_pieces)):
            if ("%" if how == "url" else "\\") in layer.text or (how == "unicode" and "&#" in layer.text):
                new, where = put_in(layer.text, pieces(layer.text))
                if where.starts:
                    self.push(Layer(new, (*layer.how, how), self.via(layer, where.back), where))
        for m in BASE64.finditer(layer.text):
            self.try_base64(layer, m.start(), m.end())
        for pattern, start in ((PERCENT, 1), (BYTES, 2)):
            for m in pattern.finditer(layer.text) if layer.text.find("%" if start == 1 else "\\x") >= 0 else ():
                raw = bytes.fromhex(m[0].replace("%", "").replace("\\x", ""))
                self.try_stream(layer, raw, m.start(), m.end(), "url" if start == 1 else "unicode")

    def via(self, layer: Layer, inner: Back) -> Back:
        return lambda start, end: layer.back(*inner(start, end))

    def push(self, layer: Layer) -> None:
        """To the worklist, unless the same content was there at the same place."""
        if not layer.text:
            return
        key = (blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.back(0, len(layer.text)))
        if key not in self.seen:
            self.seen.add(key)
            self.work.append(layer)

    def try_base64(self, layer: Layer, start: int, end: int) -> None:
        if not self.whole_base64(layer, start, end):
            tried = {(start, end)}
            for pattern in PARTS:  # lines, and stretches of either alphabet between marks of the other
                for m in pattern.finditer(layer.text, start, end):
                    if m.end() - m.start() >= SHORTEST and m.span() not in tried:
                        tried.add(m.span())
                        self.whole_base64(layer, *m.span())

    def whole_base64(self, layer: Layer, start: int, end: int) -> bool:
        chars = layer.text[start:end]
        broken = "\n" in chars
        raw = base64_bytes(re.sub(r"[\r\n]", "", chars) if broken else chars)
        if raw is None:
            return False
        if self.try_stream(layer, raw, start, end, "base64"):
            return True
        found = readable(raw)
        if found is None:
            return False
        text, encoding = found
        places = [i for i, c in enumerate(chars) if c not in "\r\n"] if broken else None
        offsets = None
        if encoding == "utf-8" and not text.isascii():
            offsets, size = [0], 0
            for c in text:
                size += len(c.encode())
                offsets.append(size)

        def back(first: int, last: int) -> tuple[int, int]:
            """From characters to bytes, from bytes to characters of base64."""
            a, b = (offsets[first], offsets[last]) if offsets else (first * (2 if encoding != "utf-8" else 1), last * (2 if encoding != "utf-8" else 1))
            a, b = a * 8 // 6, -(-b * 8 // 6)
            return (start + places[a], start + places[b - 1] + 1) if places else (start + a, start + b)

        self.push(Layer(text, (*layer.how, "base64" if encoding == "utf-8" else "base64 utf-16"), self.via(layer, back)))
        return True

    def try_stream(self, layer: Layer, raw: bytes, start: int, end: int, how: str) -> bool:
        """Open a compressed stream; all of its characters stand for the whole stretch."""
        try:
            found = unpacked(raw, self.left)
        except OverflowError:
            self.unopened += 1
            return True
        if found is None:
            return False
        kind, content = found
        self.left -= len(content)
        text = content.decode("utf-8", "replace") if stream_of(content) is None else None
        if text is None:  # a stream in a stream
            return self.try_stream(Layer("", (*layer.how, how), layer.back), content, start, end, kind) if self.new(content, layer, start, end) else True
        self.push(Layer(text, (*layer.how, how, kind), lambda _, __: layer.back(start, end)))
        return True

    def new(self, content: bytes, layer: Layer, start: int, end: int) -> bool:
        key = (blake2b(content, digest_size=16, person=b"stream").digest(), *layer.back(start, end))
        known = key in self.seen
        self.seen.add(key)
        return not known


SPAN = "array<struct<kind:string,start:int,end:int,how:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_unpacked: int = MOST_UNPACKED) -> DataFrame:
    """Return ``doc_id, spans array<struct<kind, start, end, how>>, n_layers int, unopened int`` for every row; one narrow pass.

    Spans are of the text, in code points, by start, then kind as listed, then end. ``how`` is empty for secrets that stand in the text, else the
    encodings around the secret from outside inwards (``url>base64>gzip``). A secret of a compressed stream has the stretch of the stream.

    * null and empty texts have no spans; a text is searched whole, however long; a span found in two ways is there once.
    * repeated rows each give a row, ids may be null, other columns are not read, an empty table gives no rows.
    * only unpacked streams can be larger than what holds them: beyond ``most_unpacked`` bytes in one text a stream stays closed
      and is counted in ``unopened``.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("how", pa.string())]))
        for batch in batches:
            spans, layers, unopened = [], [], []
            for text in batch.column("text"):
                scan = Scan(text.as_py(), most_unpacked)
                found = sorted(scan.spans.items(), key=lambda s: (s[0][1], RANK[s[0][0]], s[0][2]))
                spans.append([{"kind": k, "start": a, "end": b, "how": how} for (k, a, b), how in found])
                layers.append(scan.layers)
                unopened.append(scan.unopened)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(layers, pa.int32()), pa.array(unopened, pa.int32())], ["doc_id", "spans", "n_layers", "unopened"])
        give_back()

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(search, f"doc_id {kind}, spans {SPAN}, n_layers int, unopened int")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the secrets that stand in the text, and all spans as text, derived from :func:`find_secrets`."""
    base = F.filter("spans", lambda s: s["how"] == "")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    found = find_secrets(docs, id_col, text_col)
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"), "n_layers", "unopened")

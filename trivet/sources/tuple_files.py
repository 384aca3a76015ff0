"""Labelled tuple files of any size.

A tuple file assigns a list of ``(context, username, password)`` to ``dataset``. Spark's text source cuts files into blocks at
closing parentheses, so neither a file nor a line of it is ever one value. Where a block begins, a string, a comment or brackets may be
open; that is found out in three steps:

1. each block is read from every lexical mode that it may begin in, which gives the mode and the depth of brackets at its end, where
   a list begins and where brackets of earlier blocks close;
2. the blocks of a file are chained, a small record each, which gives the mode and depth of each beginning and the list's two ends;
3. each block is read again from its true beginning. Items inside it are evaluated where they stand; an item over a border of
   blocks is put together from its fragments.

Files that are no such literal are searched with a pattern, each as a stream.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivet.operators.clusters import written
from trivet.sources.batches import small_batches

#: Fixed value: a tuple of a triple-quoted context, a user name and a password in text that is no valid literal.
TUPLE = r'(?s)\(\s*"""(.*?)"""\s*,\s*(None|"[^"]*"|\'[^\']*\'|[^,)]*)\s*,\s*(None|"[^"]*"|\'[^\']*\'|[^)]*)\s*\)'

CODE, COMMENT = "code", "#"
MODES = (CODE, COMMENT, "'", '"', "'''", '"""')
SPECIAL = re.compile(r"""'''|\"\"\"|['"\#,()\[\]{}]|^dataset[ \t]*=[ \t]*\[""", re.M)
ENDS = {COMMENT: re.compile(r"\n")} | {q: re.compile(rf"\\.|{q}" + (r"|\n" if len(q) == 1 else ""), re.S) for q in MODES[2:]}
DEEPEST = 64
SEARCHED_AHEAD = 1_000_000  # characters behind a match of the pattern that may change it
FEW_BLOCKS = 200_000
HELD_CHARS = 1_000_000  # of rows that a task holds before it hands them on

Event = tuple[int, int, str]


def tokens(text: str, mode: str) -> Iterator[tuple[str, int, int, str]]:
    """Brackets, commas and list heads of code, as ``token, start, end, mode``; at last an empty token with the mode at the end."""
    at = 0
    while True:
        m = (SPECIAL if mode == CODE else ENDS[mode]).search(text, at)
        if m is None:
            yield "", len(text), len(text), mode
            return
        t, at = m[0], m.end()
        if mode != CODE:
            if t[0] != "\\":
                mode = CODE
                if t == "\n" and m.re is not ENDS[COMMENT]:
                    yield "!", m.start(), at, mode  # a string that its line does not close
        elif t == "#" or t in MODES:
            mode = t
        else:
            yield t, m.start(), at, mode


class Lane:
    """What reading a block from one mode tells; depths are relative to that of its beginning."""

    def __init__(self, mode: str):
        self.mode, self.depth, self.low, self.bad = mode, 0, 0, False
        self.lows: list[Event] = []  # where depths below the beginning's are reached first
        self.begins: dict[int, list] = {}  # where the first list begins at a depth, and where it closes
        self.open: set[int] = set()

    def read(self, unit: str, no: int) -> None:
        for t, start, end, mode in tokens(unit, self.mode):
            if t in ("(", "[", "{"):
                self.depth += 1
            elif t in (")", "]", "}"):
                self.depth -= 1
                if self.depth < self.low:
                    self.low = self.depth
                    if len(self.lows) < DEEPEST:
                        self.lows.append((no, start, t))
                if self.depth in self.open:
                    self.open.discard(self.depth)
                    self.begins[self.depth][1] = (no, start, t)
            elif t.startswith("dataset"):
                if self.depth not in self.begins and len(self.begins) < DEEPEST:
                    self.begins[self.depth] = [(no, end, "["), None]
                    self.open.add(self.depth)
                self.depth += 1
            elif t == "!":
                self.bad = True
        self.mode = mode

    def told(self) -> dict:
        return {"mode": self.mode, "depth": self.depth, "lows": self.lows, "begins": self.begins, "bad": self.bad}


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, dict, int]]:
    """``file, block, text, other columns of a block's first row (else nothing), bytes``. The parenthesis that Spark has cut at stands
    before every text but a file's first."""
    own = None
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("file", "block", "value")]
        more = {c: batch.column(c) for c in names}
        for i, (file, block, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")))):
            first, own = (file, block) != own, (file, block)
            text = value if first and block == 0 else ")" + value
            size = len(text.encode("utf-8", "surrogatepass"))
            if first and block == 0:
                text = text.removeprefix("\ufeff")
            yield file, block, text.replace("\r\n", "\n").replace("\r", "\n"), {c: more[c][i].as_py() for c in names} if first else {}, size


def blocks_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Step 1: a record for each block."""
    key, lanes, no, size, whole = None, [], 0, 0, 0

    def record() -> pa.RecordBatch:
        told = json.dumps({begun: lane.told() for begun, lane in lanes})
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "size": [size], "whole": [whole], "told": [told]})

    for file, block, text, more, n in units(batches):
        if more:
            if key:
                yield record()
            key, no, size, whole = (file, block), 0, 0, more["file_size"]
            lanes = [(m, Lane(m)) for m in (MODES if block else (CODE,))]
        for _, lane in lanes:
            lane.read(text, no)
        no, size = no + 1, size + n
    if key:
        yield record()


PLAN = "file string, block bigint, mode string, depth int, begin_block bigint, begin_no int, begin_at int, end_block bigint, end_no int, end_at int, ok boolean"


def chained(group: pd.DataFrame) -> pd.DataFrame:
    """Step 2: beginnings of a file's blocks, and the ends of its list."""
    group = group.sort_values("block")
    mode, depth, begin, end, bad, rows = CODE, 0, None, None, False, []
    for block, told in zip(group["block"].tolist(), group["told"]):
        lane = json.loads(told)[mode]
        rows.append((mode, depth))
        if begin is None:
            found = lane["begins"].get(str(-depth))
            if found:
                begin = (block, *found[0])
                end = found[1] and (block, *found[1])
        elif end is None and 0 < depth <= len(lane["lows"]):
            end = (block, *lane["lows"][depth - 1])
        mode, depth, bad = lane["mode"], depth + lane["depth"], bad or lane["bad"]
    last = depth == 1 and int(group["size"].sum()) + 1 == int(group["whole"].iloc[0])  # a parenthesis at the very end
    ok = bool(begin and end and end[3] == "]" and (depth == 0 or last) and mode in (CODE, COMMENT) and not bad)
    b, e = (begin, end) if ok else ((-1, 0, 0), (-1, 0, 0))
    out = pd.DataFrame(rows, columns=["mode", "depth"])
    out.insert(0, "block", group["block"].values)
    out.insert(0, "file", group["file"].values)
    return out.assign(begin_block=b[0], begin_no=b[1], begin_at=b[2], end_block=e[0], end_no=e[1], end_at=e[2], ok=ok).astype({"depth": "int32"})


class NoLiteral(ValueError):
    """An item that is no literal."""


def row_of(text: str) -> tuple | None:
    """The first three values of an item, nothing for shorter and other items."""
    try:
        value = ast.literal_eval(f"({text}\n)")
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as e:
        if not re.sub(r"#[^\n]*", "", text).strip():
            return None  # behind the last comma
        raise NoLiteral from e
    return tuple(None if x is None else str(x) for x in value[:3]) if isinstance(value, (tuple, list)) and len(value) >= 3 else None


PARSED = "file string, block bigint, kind string, place int, context string, username string, password string, text string"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: rows of items inside a block; fragments of items over its borders; what stands around the list."""
    rows: list[tuple] = []
    names = [c.split()[0] for c in PARSED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4]
    key, plan, item, around, place, no, open_item, held = None, {}, [], [], 0, 0, False, 0

    def batch() -> pa.RecordBatch:
        nonlocal held
        held = 0
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        rows.clear()
        return out

    def add(kind: str, values: tuple = (None, None, None), text: str | None = None) -> None:
        nonlocal held
        held += 100 + sum(len(x) for x in (*values, text) if x)
        rows.append((*key, kind, place, *values, text))

    def border() -> None:
        """An item ends here."""
        nonlocal place, open_item
        text = "".join(item)
        item.clear()
        if open_item:  # it began in an earlier block
            add("head", text=text)
            open_item = False
            return
        try:
            values = row_of(text)
        except NoLiteral:
            add("bad")
            return
        if values:
            place += 1
            add("row", values)

    def end() -> None:
        if inside:
            add("mid" if open_item else "tail", text="".join(item))
        item.clear()
        if any(around):
            add("around", text="".join(around))
        around.clear()

    inside, mode, depth = False, CODE, 0
    for file, block, text, more, _ in units(batches):
        if more:
            if key and plan["ok"]:
                end()
            key, plan, place, no = (file, block), more, 0, 0
            mode, depth = plan["mode"], plan["depth"]
            inside = plan["ok"] and plan["begin_block"] < block <= plan["end_block"]
            open_item = inside
        if not plan["ok"]:
            continue
        at = 0
        if not inside and (block, no) == (plan["begin_block"], plan["begin_no"]):
            around.append(text[: plan["begin_at"]])
        stop = plan["end_at"] if (block, no) == (plan["end_block"], plan["end_no"]) else None
        started = inside
        for t, start, after, mode in tokens(text, mode):
            if not inside and (block, no, after) == (plan["begin_block"], plan["begin_no"], plan["begin_at"]):
                inside, started, at = True, True, after
            elif inside and start == stop:
                item.append(text[at:start])
                border()
                inside, at = False, start
            elif inside and t == "," and depth == 1:
                item.append(text[at:start])
                border()
                at = after
            depth += (t in ("(", "[", "{") or t.startswith("dataset")) - (t in (")", "]", "}"))
        if inside:
            item.append(text[at:])
        else:
            around.append(text[at:] if started else text)
        no += 1
        if held >= HELD_CHARS:
            yield batch()
    if key and plan["ok"]:
        end()
    if rows:
        yield batch()


def mended(group: pd.DataFrame) -> pd.DataFrame:
    """Items from their fragments, and whether what stands around a list is Python; a few fragments a block."""
    group = group.assign(_o=group["kind"].map({"head": 0, "mid": 1, "tail": 2, "around": 3})).sort_values(["block", "_o"])
    held, since, out, rest = [], None, [], []
    for block, kind, place, text in zip(group["block"], group["kind"], group["place"], group["text"]):
        if kind == "around":
            rest.append(text)
            continue
        if kind == "tail":
            held, since = [text], (block, place)
        else:
            held.append(text)
        if kind == "head":
            try:
                values = row_of("".join(held))
                if values:
                    out.append((since[0], "row", since[1] + 1, *values))
            except NoLiteral:
                out.append((block, "bad", 0, None, None, None))
    try:
        compile("".join(rest), "rows", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        if not _closed_later(rest):
            out.append((0, "bad", 0, None, None, None))
    done = pd.DataFrame(out, columns=["block", "kind", "place", "context", "username", "password"])
    done.insert(0, "file", group["file"].iloc[0])
    return done.astype({"place": "int32", "block": "int64"})


def _closed_later(rest: list[str]) -> bool:
    """Whether the rest is Python with the parenthesis that a file's very end may lack."""
    try:
        compile("".join(rest) + ")", "rows", "exec", dont_inherit=True)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of the pattern in files as streams: a match counts when enough text behind it is known, or the file's end."""
    pattern = re.compile(TUPLE, re.A)
    begin = re.compile(r'\(\s*"""', re.A)
    key, held, index, wait, size, pieces, left = None, "", 0, 0, 0, [], 0
    rows: list[tuple] = []
    found = 0

    def search(last: bool) -> None:
        nonlocal held, index, wait, pieces, size, found
        held, pieces = held + "".join(pieces), []
        at = 0
        while (m := pattern.search(held, at)) and (last or len(held) - m.end() >= SEARCHED_AHEAD):
            index += 1
            rows.append((key, index, *m.groups()))
            found += 100 + m.end() - m.start()
            at = m.end()
        m = begin.search(held, at)
        held = held[m.start() if m else max(at, len(held) - SEARCHED_AHEAD) :]
        size = len(held)
        wait = 2 * size + 2 * SEARCHED_AHEAD  # so that text which matches late is not searched over and over

    def batch() -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), *[pa.string()] * 3]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["file", "source_index", "context", "username", "password"])
        nonlocal found
        rows.clear()
        found = 0
        return out

    def finish() -> None:
        if left == 1:  # the file ends with a parenthesis
            pieces.append(")")
        search(True)

    for file, _, text, more, n in units(batches):
        if file != key:
            if key is not None:
                finish()
            key, held, index, size, pieces, wait, left = file, "", 0, 0, [], 2 * SEARCHED_AHEAD, more["file_size"]
        pieces.append(text)
        size, left = size + len(text), left - n
        if size >= wait:
            search(False)
        if found >= HELD_CHARS:
            yield batch()
    if key is not None:
        finish()
    if rows:
        yield batch()


def read_tuples(spark: SparkSession, path: str, fallback: bool = True) -> DataFrame:
    """``source_file, source_index (from 1), context, username, password`` of labelled tuple files.

    Rows are those of the first list that a file assigns to ``dataset`` at the beginning of a line; items of fewer than three values are
    left out and not counted. A file is a literal to its end or not at all: one whose items, or whose text around the list, are no Python
    is searched with :data:`TUPLE` instead, unless ``fallback`` is false. Items may be of any nesting that Python can read; empty
    files have no rows.

    A file is read by as many tasks as it has blocks of ``spark.sql.files.maxPartitionBytes``; files for the pattern by one, as a stream.
    """
    lines = spark.read.option("lineSep", ")").text(path)
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")]
    pieces = lines.select("value", meta[0].alias("file"), meta[1].alias("block"), meta[2].alias("file_size"))
    with small_batches(spark):
        told = pieces.mapInArrow(blocks_told, "file string, block bigint, size bigint, whole bigint, told string")
        plan = written(told.groupBy("file").applyInPandas(chained, PLAN))
    keys = ["file", "block"]
    with_plan = pieces.select("value", *keys, F.monotonically_increasing_id().alias("i"))
    if plan.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS:  # about 100 bytes each
        with_plan = with_plan.join(F.broadcast(plan), keys)
    else:
        with_plan = with_plan.join(plan, keys).repartition(*keys).sortWithinPartitions(*keys, "i")
    with small_batches(spark):
        found = written(with_plan.drop("i").mapInArrow(parsed, PARSED))
    mend = found.filter("kind IN ('head', 'mid', 'tail', 'around')").groupBy("file")
    mended_rows = written(mend.applyInPandas(mended, "file string, block bigint, kind string, place int, context string, username string, password string"))
    both = found.filter("kind IN ('row', 'bad')").drop("text").unionByName(mended_rows)
    bad = both.filter("kind = 'bad'").select("file").unionByName(plan.filter("NOT ok").select("file")).distinct()
    rows = both.filter("kind = 'row'").join(bad, "file", "left_anti")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    starts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("start"))
    name = F.element_at(F.split("file", "/"), -1).alias("source_file")
    literal = rows.join(starts, keys).select(name, (F.col("start") + F.col("place")).cast("int").alias("source_index"), "context", "username", "password")
    if not fallback or bad.isEmpty():
        return literal
    stream = pieces.withColumn("i", F.monotonically_increasing_id()).join(bad, "file", "left_semi")
    stream = stream.repartition("file").sortWithinPartitions("file", "block", "i").drop("i")
    with small_batches(spark):
        again = written(stream.mapInArrow(searched, "file string, source_index int, context string, username string, password string"))
    return literal.unionByName(again.select(name, "source_index", "context", "username", "password"))

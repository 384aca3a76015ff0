"""JSON arrays of any size.

Spark's text source cuts files into blocks at closing braces, so neither a file nor a line of it is ever one value. Where a block begins,
a text or brackets may be open; as with tuple files (:mod:`trivet.sources.tuple_files`) each block is first read from every mode that it
may begin in, a small record a block is chained, and each block is read again from its true beginning. Elements inside a block
come out where they stand; one over borders of blocks is put together from its fragments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.operators.clusters import written
from trivet.sources.batches import small_batches

CODE = "code"
MODES = (CODE, '"', "'")
SPECIAL = {CODE: re.compile(r"""["'\[\]{},]"""), '"': re.compile(r'(?:[^"\\]++|\\.)*+"', re.S), "'": re.compile(r"(?:[^'\\]++|\\.)*+'", re.S)}
OPEN, CLOSE = ("[", "{"), ("]", "}")
BLANK = " \t\r\n"
FEW_BLOCKS = 200_000
HELD_CHARS = 1_000_000  # of elements that a task holds before it hands them on


def tokens(text: str, mode: str) -> Iterator[tuple[str, int, int, str]]:
    """Brackets and commas outside of texts, as ``token, start, end, mode``; at last an empty token with the mode at the end."""
    at = 0
    while True:
        m = SPECIAL[mode].search(text, at) if mode == CODE else SPECIAL[mode].match(text, at)
        if m is None:
            yield "", len(text), len(text), mode
            return
        at = m.end()
        if mode != CODE:
            mode = CODE
        elif m[0] in MODES:
            mode = m[0]
        else:
            yield m[0], m.start(), at, mode


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, dict, int]]:
    """``file, block, text, other columns of a block's first row (else nothing), bytes``. The brace that Spark has cut at stands before
    every text but a file's first."""
    own = None
    for batch in batches:
        names = [c for c in batch.schema.names if c not in ("file", "block", "value")]
        values, sizes = batch.column("value"), pc.binary_length(batch.column("value")).to_pylist()
        for i, (file, block) in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())):
            first, own = (file, block) != own, (file, block)
            begins, text = first and block == 0, values[i].as_py()
            yield file, block, text.removeprefix("\ufeff") if begins else "}" + text, {c: batch.column(c)[i].as_py() for c in names} if first else {}, sizes[i] + (not begins)


def blocks_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: a record for each block: its bytes, its first character that is not blank, and for each mode that it may begin in the
    mode at its end, the change of depth and the least depth behind a closing bracket."""
    key, lanes, head, size, whole = None, {}, "", 0, 0

    def record() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "size": [size], "whole": [whole], "head": [head], "told": [json.dumps(lanes)]})

    for file, block, text, more, n in units(batches):
        if more:
            if key:
                yield record()
            key, head, size, whole = (file, block), "", 0, more["file_size"]
            lanes = {m: [m, 0, None] for m in (MODES if block else (CODE,))}
        head, size = head or text.lstrip(BLANK)[:1], size + n
        for lane in lanes.values():
            for t, _, _, mode in tokens(text, lane[0]):
                if t in OPEN:
                    lane[1] += 1
                elif t in CLOSE:
                    lane[1] -= 1
                    lane[2] = lane[1] if lane[2] is None else min(lane[2], lane[1])
            lane[0] = mode
    if key:
        yield record()


PLAN = "file string, block bigint, mode string, depth int, listed boolean, ended boolean, ok boolean, last boolean"


def chained(group: pd.DataFrame) -> pd.DataFrame:
    """Step 2: beginnings of a file's blocks. ``listed``: the value is an array, not one object; ``ended``: it ends in an earlier block;
    ``last``: the brace that the text source has cut off at the file's end closes it."""
    group = group.sort_values("block")
    mode, depth, ended, rows = CODE, 0, False, []
    for told in group["told"]:
        rows.append((mode, depth, ended))
        end, change, low = json.loads(told)[mode]
        ended = ended or low is not None and depth + low <= 0
        mode, depth = end, depth + change
    cut = int(group["size"].sum()) < int(group["whole"].iloc[0])
    last = not ended and mode == CODE and depth == 1 and cut
    head = next((h for h in group["head"] if h), "")
    out = pd.DataFrame(rows, columns=["mode", "depth", "ended"])
    out = out.assign(file=group["file"].values, block=group["block"].values, listed=head == "[", ok=bool(head == "[" and ended or head == "{" and (ended or last)), last=False)
    out.loc[out.index[-1], "last"] = last
    return out[[c.split()[0] for c in PLAN.split(", ")]].astype({"depth": "int32"})


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: elements inside a block, fragments of those over its borders."""
    rows: list[tuple] = []
    held, key, plan, item, mode, depth = 0, None, {}, [], CODE, 0
    level, inside, open_item, fresh, groups = 1, False, False, False, 0

    def batch() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "block", "kind", "text"])
        rows.clear()
        held = 0
        return out

    def add(kind: str, text: str) -> None:
        nonlocal held
        rows.append((*key, kind, text))
        held += 100 + len(text)

    def border(ends: bool) -> None:
        """An element ends here, and the array with it if ``ends``."""
        nonlocal open_item, fresh, groups
        text = "".join(item)
        item.clear()
        if open_item:
            add("head", text)
        elif text.strip(BLANK):
            add("row" if groups <= 1 else "bad", text)
        elif not (ends and fresh):
            add("bad", "")
        open_item, fresh, groups = False, False, 0

    def end() -> None:
        if plan["last"]:
            item.append("}")
            border(True)
        elif inside:
            add("mid" if open_item else "tail", "".join(item))
        item.clear()

    for file, block, text, more, _ in units(batches):
        if more:
            if key and plan["ok"]:
                end()
            key, plan = (file, block), more
            mode, depth, level = plan["mode"], plan["depth"], int(plan["listed"])
            open_item = inside = block > 0 and not plan["ended"]
            ended, groups = plan["ended"], 0
        if not plan["ok"] or ended:
            continue
        at = 0
        for t, start, after, mode in tokens(text, mode):
            if t in OPEN:
                if not inside:
                    inside, fresh, at = True, True, after if level else 0
                    groups += not level
                elif depth == level:
                    groups += 1
                depth += 1
            elif t in CLOSE:
                depth -= 1
                if depth == 0:
                    item.append(text[at : start if level else after])
                    if level and t != "]":
                        add("bad", "")
                    border(True)
                    inside, ended = False, True
                    break
            elif t == "," and depth == 1 and level:
                item.append(text[at:start])
                border(False)
                at = after
        if inside:
            item.append(text[at:])
        if held >= HELD_CHARS:
            yield batch()
    if key and plan["ok"]:
        end()
    if rows:
        yield batch()


def mended(group: pd.DataFrame) -> pd.DataFrame:
    """Elements of a file from their fragments, a few for each block."""
    group = group.assign(_o=group["kind"].map({"head": 0, "mid": 1, "tail": 2})).sort_values(["block", "_o"])
    held, out = [], []
    for kind, text in zip(group["kind"], group["text"]):
        held = [text] if kind == "tail" else [*held, text]
        if kind == "head":
            out.append(("row" if _is_one("".join(held)) else "bad", "".join(held)))
    done = pd.DataFrame(out, columns=["kind", "text"])
    done.insert(0, "file", group["file"].iloc[0])
    return done


def _is_one(text: str) -> bool:
    """Whether the text has one bracket at most that nothing else holds, and anything at all."""
    depth, n = 0, 0
    for t, *_ in tokens(text, CODE):
        n += depth == 0 and t in OPEN
        depth += (t in OPEN) - (t in CLOSE)
    return n <= 1 and bool(text.strip(BLANK))


def read_elements(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``fields`` of the objects of JSON arrays, or of single objects, a file each; a byte order mark is no hindrance. A null element is
    a row of nulls, fields that are missing or of another type are null, and a file that is no such JSON to its end has no rows. Text
    behind the value does not count. A file is read by as many tasks as it has blocks of ``spark.sql.files.maxPartitionBytes``."""
    lines = spark.read.option("lineSep", "}").text(path)
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")]
    pieces = lines.select("value", meta[0].alias("file"), meta[1].alias("block"), meta[2].alias("file_size"))
    keys = ["file", "block"]
    with small_batches(spark):
        told = pieces.mapInArrow(blocks_told, "file string, block bigint, size bigint, whole bigint, head string, told string")
        plan = written(told.groupBy("file").applyInPandas(chained, PLAN))
        with_plan = pieces.select("value", *keys, F.monotonically_increasing_id().alias("i"))
        if plan.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS:  # about 100 bytes each
            with_plan = with_plan.join(F.broadcast(plan), keys)
        else:
            with_plan = with_plan.join(plan, keys).repartition(*keys).sortWithinPartitions(*keys, "i")
        found = written(with_plan.drop("i").mapInArrow(parsed, "file string, block bigint, kind string, text string"))
        ends = found.filter("kind IN ('head', 'mid', 'tail')").groupBy("file").applyInPandas(mended, "file string, kind string, text string")
        ends = written(ends)
    every = found.filter("kind IN ('row', 'bad')").select("file", "kind", "text").unionByName(ends)
    # A schema of no field of the text: only its form counts.
    form = F.from_json("text", "_none string, _broken string", {"columnNameOfCorruptRecord": "_broken"})["_broken"]
    null = F.trim(F.translate("text", "\t\r\n", "   ")) == "null"
    bad = every.filter((F.col("kind") == "bad") | form.isNotNull() & ~null).select("file").distinct()
    rows = every.filter("kind = 'row'").join(bad, "file", "left_anti")
    return rows.select(F.from_json("text", fields).alias("r")).select("r.*")

"""Repair of conversations' structure by a tensor dynamic programme.

Roles have to read ``(s?(ua)+)?`` by their initials. A row is kept, given another role or deleted, and empty rows are inserted; the
cheapest edits win, and among those the ones whose initials come first. Four states say where in the pattern a conversation stands.
Conversations of one batch are bucketed by length; for all of a bucket at once the least cost of the rest is computed turn by turn
from the end and stored (a tensor of turns x conversations x states), then the edits are traced from the start.

Rows are sorted by range, so that a conversation of any size stands in several partitions. What lies wholly inside a partition is
repaired there. The conversations at the borders and very long ones go in blocks: a block's costs between its states at both ends are a
matrix, the matrices of a conversation give what follows each block, each block is traced from every state, and the states are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivet.llm.common import cut, give_back

# fixed values: costs, initials of edits and what ends a sentence
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ENDS = ".!?"
# end of fixed values
WHITE = " \t\n\x0b\x0c\r"
INITIALS = {"s": 0, "u": 1, "a": 2}  # others are 3
LEGAL = {(0, 1), (1, 2), (2, 1)}
PLAIN, CUT_OFF, BLANK, REPEATED = range(4)  # faults
START, AFTER_S, AFTER_U, AFTER_A = range(4)  # states; a conversation may end in the first and the last
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])  # where an inserted or renamed row leads
NAMES = {AFTER_U: "user", AFTER_A: "assistant"}
FAR = 1 << 50
PAD = 16  # a place behind the end of a shorter conversation
NO_EDIT, D, I, K, R = 0, *b"DIKR"
END = np.array([0, FAR, FAR, 0])

BUCKET_CHARS = 8_000_000  # a row counts as 100 and its text
LONG_ROWS = 20_000
BLOCK_ROWS = 65_536


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (initial x 4 + fault) and state: the cost between states, the cost of keeping, the state that keeping leads to."""
    moves, keep, to = np.full((17, 4, 4), FAR), np.full((17, 4), FAR), np.zeros((17, 4), np.int64)
    for initial in range(4):
        for fault in range(4):
            code = initial * 4 + fault
            more = TRUNCATED if fault == CUT_OFF else 0
            for state in range(4):
                moves[code, state, state] = DELETE
                if fault in (BLANK, REPEATED):
                    continue
                moves[code, state, NEXT[state]] = min(moves[code, state, NEXT[state]], REROLE + more)
                if (initial, state) == (0, START) or initial == 1 and state != AFTER_U or (initial, state) == (2, AFTER_U):
                    keep[code, state], to[code, state] = more, (AFTER_S, AFTER_U, AFTER_A)[initial]
                    moves[code, state, to[code, state]] = more
    moves[PAD] = np.where(np.eye(4, dtype=bool), 0, FAR)
    return moves, keep, to


MOVES, KEEP, KEEP_TO = _tables()


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs where rows may be inserted first; two in a row are the most that can help."""
    out = costs.copy()
    out[:, AFTER_U] = np.minimum(costs[:, AFTER_U], INSERT + costs[:, AFTER_A])
    out[:, AFTER_A] = np.minimum(costs[:, AFTER_A], INSERT + costs[:, AFTER_U])
    for state in (START, AFTER_S):
        out[:, state] = np.minimum(costs[:, state], INSERT + out[:, AFTER_U])
    return np.minimum(out, FAR)


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs of what follows, ``[turn, conversation, state]``; ``codes`` is ``[turn, conversation]``, ``end`` what holds behind it."""
    out = np.empty((len(codes) + 1, codes.shape[1], 4), np.int64)
    out[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        out[t] = closed((MOVES[codes[t]] + out[t + 1][:, None, :]).min(2))
    return out


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits that come first, ``[conversation, place]`` with three places a turn, and the state behind them. Where
    ``last``, rows may be inserted at the end."""
    turns, n = codes.shape
    lane, state = np.arange(n), state.copy()
    edits = np.zeros((turns + 1, 3, n), np.uint8)
    for t in range(turns):
        code, open_ = codes[t], codes[t] != PAD
        for place in range(3):
            best = costs[t, lane, state]
            letter = np.where(
                DELETE + costs[t + 1, lane, state] == best, D,
                np.where(INSERT + costs[t, lane, NEXT[state]] == best, I, np.where(KEEP[code, state] + costs[t + 1, lane, KEEP_TO[code, state]] == best, K, R)),
            )
            edits[t, place] = np.where(open_, letter, NO_EDIT)
            moved = np.where(letter == K, KEEP_TO[code, state], np.where(letter == D, state, NEXT[state]))
            state = np.where(open_, moved, state)
            open_ &= letter == I
    for place in range(2):
        more = last & (INSERT + costs[turns, lane, NEXT[state]] == costs[turns, lane, state])
        edits[turns, place] = np.where(more, I, NO_EDIT)
        state = np.where(more, NEXT[state], state)
    return edits.transpose(2, 0, 1).reshape(n, -1), state


def letters(edits: np.ndarray) -> bytes:
    return edits.tobytes().replace(b"\0", b"")


def by_length(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of conversations whose lengths share a power of two: their places in the list and their codes, time first."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    width = np.frexp(sizes.astype(float))[1]
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        tensor = np.full((len(own), int(sizes[own].max())), PAD, np.uint8)
        for row, i in enumerate(own.tolist()):
            tensor[row, : sizes[i]] = np.frombuffer(codes[i], np.uint8)
        yield own, np.ascontiguousarray(tensor.T)


def solve(codes: list[bytes]) -> list[tuple[int, str]]:
    """Cost and edits of whole conversations."""
    out: list[tuple[int, str]] = [(0, "")] * len(codes)
    for own, tensor in by_length(codes):
        n = len(own)
        ends = closed(np.tile(END, (n, 1)))
        costs = backward(tensor, ends)
        edits, _ = trace(tensor, costs, np.zeros(n, np.int64), np.ones(n, bool))
        for i, cost, row in zip(own.tolist(), costs[0, :, START].tolist(), edits):
            out[i] = cost, letters(row).decode()
    return out


def repaired_rows(rows: Iterator[tuple[str, str]], edits: Iterable[str], state: int = START) -> Iterator[str]:
    """``role:text`` of the rows that stay, and of those put in."""
    for edit in edits:
        if edit == "I":
            state = int(NEXT[state])
            yield f"{NAMES[state]}:"
            continue
        role, text = next(rows)
        if edit == "K":
            state = int(KEEP_TO[INITIALS[role[:1]] * 4, state])
            yield f"{role}:{text}"
        elif edit == "R":
            state = int(NEXT[state])
            yield f"{NAMES[state]}:{text}"


def fault_of(text: str) -> int:
    """Blank, cut off, or plain; whether a row is a repetition, its conversation says."""
    solid = text.strip(WHITE)
    return BLANK if not solid else PLAIN if solid[-1] in ENDS else CUT_OFF


class Tally:
    """Counts over rows in order, of one conversation or of a block of it."""

    def __init__(self) -> None:
        self.rows = self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, code: int, times: int = 1) -> None:
        initial = code >> 2
        if self.rows:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.illegal += times - 1
        self.rows += times
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, more: Tally) -> None:
        """Put what follows behind."""
        if self.rows and more.rows:
            self.illegal += (self.last, more.first) not in LEGAL
        self.turns += more.turns - (self.high is not None and self.high == more.low)
        self.illegal += more.illegal
        self.faults = [a + b for a, b in zip(self.faults, more.faults)]
        self.first = self.first if self.rows else more.first
        self.last = more.last if more.rows else self.last
        self.rows += more.rows
        self.low = more.low if self.low is None else self.low
        self.high = self.high if more.high is None else more.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def result(tally: Tally, cost: int, audit: str, digest: str) -> dict:
    return {
        "gaps": tally.gaps, "blank": tally.faults[BLANK], "duplicate": tally.faults[REPEATED], "truncated": tally.faults[CUT_OFF],
        "illegal": tally.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest,
    }


def code_rows(rows: list[Row]) -> tuple[bytes, Tally]:
    """The code of each row of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    codes, tally = bytearray(), Tally()
    for turn, role, text in rows:
        fault = fault_of(text)
        if fault != BLANK and (role, text) in seen:
            fault = REPEATED
        seen.add((role, text))
        codes.append(INITIALS.get(role[:1], 3) * 4 + fault)
        tally.add(turn, codes[-1])
        tally.faults[fault] += 1
    return bytes(codes), tally


def repair_all(held: list[tuple[object, list[Row]]], texts: bool) -> Iterator[tuple[object, dict]]:
    """Repair whole conversations."""
    coded = [code_rows(rows) for _, rows in held]
    for (key, rows), (_, tally), (cost, audit) in zip(held, coded, solve([codes for codes, _ in coded])):
        text = "\n".join(repaired_rows(((r.role, r.text) for r in rows), audit))
        found = result(tally, cost, audit, hashlib.sha256(text.encode()).hexdigest())
        yield key, found | {"repaired": text} if texts else found


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Return ``conv_id``, counts of ``gaps, blank, duplicate, truncated, illegal``, the ``cost`` of the cheapest repair, the ``audit``
    of its edits and ``repaired_sha256`` of the repaired rows, with ``texts`` also ``repaired`` itself (of the conversation's size).

    * rows are in order of turn (nulls first), role, text. Null roles and texts are one space; a null id is a conversation.
    * extra columns are not read; repeated rows are duplicates; an empty table gives no rows; a conversation may be of any size.
    * only the digest of a conversation's repaired text, and its audit, pass through one task, as a stream.
    """
    spark = conversations.sparkSession
    src = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    kind = src.schema["conv_id"].dataType.simpleString()
    fields = RESULT + (", repaired string" if texts else "")
    order = ["conv_id", "turn", "role", "text"]
    laid = src.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of conversations inside the partition; the rows of others as they are."""
        held: list[tuple[object, list[Row]]] = []
        rows: list[Row] = []
        key, first, size, passing = None, True, 0, False
        typed: dict[str, pa.DataType] = {}

        def batch(records: list[tuple[object, Row | None, dict | None]]) -> pa.RecordBatch:
            found = pa.array([r[2] for r in records], typed["found"])
            cells = [pa.array([r[0] for r in records], typed["conv_id"])]
            cells += [pa.array([r[1] and r[1][i] for r in records], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([*cells, found], ["conv_id", "turn", "role", "text", "found"])

        def passed(some: list[Row]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(some), 2_000):
                yield batch([(key, r, None) for r in some[at : at + 2_000]])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            done = [(k, None, found) for k, found in repair_all(held, texts)]
            for at in range(0, len(done), 2_000):
                yield batch(done[at : at + 2_000])
            held.clear()
            size = 0

        typed["found"] = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in fields.split(", ")])
        for part in batches:
            typed["conv_id"] = part.schema.field("conv_id").type
            ids = part.column("conv_id").to_pylist()
            for own, row in zip(ids, zip(*(part.column(c).to_pylist() for c in order[1:]))):
                if own != key and (rows or passing):
                    if first or passing:
                        yield from passed(rows)
                    else:
                        held.append((key, rows))
                        if size > BUCKET_CHARS:
                            yield from flush()
                    rows, first, passing = [], False, False
                key = own
                rows.append(Row(*row))
                size += len(row[2]) + 100
                if len(rows) > LONG_ROWS or passing and len(rows) >= 2_000 or size > 2 * BUCKET_CHARS:
                    if held:
                        yield from flush()
                    yield from passed(rows)  # of a long conversation: go on without holding it
                    rows, passing, size = [], True, 0
        if rows or passing:
            yield from passed(rows)  # the last one may go on in the next partition
        if held:
            yield from flush()
        give_back()

    done = cut(laid.mapInArrow(inside, f"conv_id {kind}, turn bigint, role string, text string, found struct<{fields}>"))
    whole = done.filter("found IS NOT NULL").select("conv_id", "found.*")
    rest = done.filter("found IS NULL").select(*order)
    return whole if rest.isEmpty() else whole.unionByName(in_blocks(cut(rest), texts))


class Weaver:
    """Applies a block's edits to its rows as they come; rows that had to go do not come."""

    def __init__(self, edits: str, codes: bytes, state: int):
        self.edits, self.codes, self.state, self.at, self.place = edits, codes, state, 0, 0

    def _to_row(self) -> Iterator[str]:
        while self.at < len(self.edits):
            if self.edits[self.at] == "I":
                self.state = int(NEXT[self.state])
                yield f"{NAMES[self.state]}:"
            elif self.codes[self.place] & 3 in (BLANK, REPEATED):
                self.place += 1
            else:
                return
            self.at += 1

    def push(self, role: str, text: str) -> Iterator[str]:
        yield from self._to_row()
        edit, code = self.edits[self.at], self.codes[self.place]
        self.at, self.place = self.at + 1, self.place + 1
        if edit != "D":
            self.state = int((KEEP_TO[code] if edit == "K" else NEXT)[self.state])
            yield f"{role if edit == 'K' else NAMES[self.state]}:{text}"

    def finish(self) -> Iterator[str]:
        return self._to_row()


def ends_of(group: pd.DataFrame) -> pd.DataFrame:
    """What follows each block of a conversation, and the conversation's counts (with its first block)."""
    group = group.sort_values(["part", "block"])
    cost, ends, total = closed(END[None])[0], [], Tally()
    for matrix in reversed(list(group["matrix"])):
        ends.append(cost.tolist())
        cost = closed((np.asarray(matrix).reshape(4, 4) + cost[None, :]).min(1)[None])[0]
    for counts in group["tally"]:
        values, tally = [int(v) for v in counts], Tally()
        tally.rows, tally.turns, tally.illegal, tally.first, tally.last, tally.faults = *values[:5], values[5:9]
        tally.low, tally.high = (values[9], values[10]) if tally.turns else (None, None)
        total.join(tally)
    found = list(result(total, int(cost[START]), "", "").values())[:6]
    n = len(group)
    return pd.DataFrame({"part": group["part"].values, "block": group["block"].values, "after": ends[::-1], "last": [False] * (n - 1) + [True], "found": [found] + [[]] * (n - 1)})


def chained(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation begins."""
    group = group.sort_values(["part", "block"])
    state, entered = START, []
    for leads in group["leads"]:
        entered.append(state)
        state = int(leads[state])
    return pd.DataFrame({"part": group["part"].values, "block": group["block"].values, "state": entered})


def in_blocks(rows: DataFrame, texts: bool) -> DataFrame:
    """The same for conversations of any size, each in blocks; groups that meet in one task have one small record a block."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    alike = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("own", F.sha2("text", 256)))
    by_turn = F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn")))
    firsts = alike.groupBy("conv_id", "role", "own").agg(by_turn.alias("at")).select("conv_id", "role", "own", "at.turn", F.lit(True).alias("first"))
    a, f = alike.alias("a"), firsts.alias("f")
    pairs = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "own", "turn")]  # with the turn: one row at most
    marked = a.join(f, pairs, "left").select("a.conv_id", "a.turn", "a.role", "a.text", "a.times", F.coalesce("f.first", F.lit(False)).alias("first"))
    laid = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    columns = {"seq": pa.int64(), "role": pa.string(), "text": pa.string(), "codes": pa.binary(), "matrix": pa.list_(pa.int64()), "tally": pa.list_(pa.int64())}

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record for each row that may stay, and one for their block."""
        part, block, seq, key, codes, tally, id_type = TaskContext.get().partitionId(), 0, 0, None, bytearray(), Tally(), None
        records: list[tuple] = []

        def write() -> pa.RecordBatch:
            cells = [pa.array([r[0] for r in records], id_type), pa.array([part] * len(records), pa.int32()), pa.array([r[1] for r in records], pa.int32())]
            cells += [pa.array([r[i] for r in records], t) for i, t in enumerate(columns.values(), 2)]
            records.clear()
            return pa.RecordBatch.from_arrays(cells, ["conv_id", "part", "block", *columns])

        def end() -> None:
            nonlocal block, codes, tally
            lanes = np.tile(np.frombuffer(bytes(codes), np.uint8)[:, None], (1, 4))
            matrix = backward(lanes, np.where(np.eye(4, dtype=bool), 0, FAR))[0].T  # from state to state
            counts = [tally.rows, tally.turns, tally.illegal, tally.first, tally.last, *tally.faults, tally.low or 0, tally.high or 0]
            records.append((key, block, -1, None, None, bytes(codes), matrix.reshape(-1).tolist(), counts))
            block, codes, tally = block + 1, bytearray(), Tally()

        def add(turn: int | None, code: int, n: int) -> None:
            nonlocal codes
            codes += bytes([code]) * n
            tally.add(turn, code, n)
            tally.faults[code & 3] += n

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, turn, role, text, times, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "first"))):
                if codes and own != key:
                    end()
                key, fault, initial = own, fault_of(text), INITIALS.get(role[:1], 3) * 4
                if first and fault != BLANK:
                    records.append((key, block, seq, role, text, None, None, None))
                    add(turn, initial + fault, 1)
                    seq, times = seq + 1, times - 1
                while times:  # these go
                    n = min(times, BLOCK_ROWS - len(codes))
                    add(turn, initial + (BLANK if fault == BLANK else REPEATED), n)
                    times -= n
                    if len(codes) >= BLOCK_ROWS:
                        end()
                if len(codes) >= BLOCK_ROWS:
                    end()
                if len(records) >= 2_000:
                    yield write()
        if codes:
            end()
        if records:
            yield write()

    blocks = cut(laid.mapInArrow(to_blocks, f"conv_id {kind}, part int, block int, seq bigint, role string, text string, codes binary, matrix array<bigint>, tally array<bigint>"))
    heads = blocks.filter("seq < 0")
    after = cut(heads.select("conv_id", "part", "block", "matrix", "tally").groupBy("conv_id").applyInPandas(ends_of, "part int, block int, after array<bigint>, last boolean, found array<bigint>"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's edits from every state, and the state behind them."""
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.tile(np.frombuffer(batch.column("codes")[i].as_py(), np.uint8)[:, None], (1, 4))
                costs = backward(codes, np.tile(np.array(batch.column("after")[i].as_py()), (4, 1)))
                edits, state = trace(codes, costs, np.arange(4), np.full(4, batch.column("last")[i].as_py()))
                ways = pa.array([[letters(row).decode() for row in edits]], pa.list_(pa.string()))
                cells = [batch.column(c).slice(i, 1) for c in ("conv_id", "part", "block", "found", "codes")]
                yield pa.RecordBatch.from_arrays([*cells, ways, pa.array([state.tolist()], pa.list_(pa.int64()))], ["conv_id", "part", "block", "found", "codes", "ways", "leads"])

    work = heads.select("conv_id", "part", "block", "codes").join(after, ["part", "block"]).select("conv_id", "part", "block", "found", "codes", "after", "last")
    ways = cut(work.mapInArrow(traced, f"conv_id {kind}, part int, block int, found array<bigint>, codes binary, ways array<string>, leads array<bigint>"))
    entered = ways.select("conv_id", "part", "block", "leads").groupBy("conv_id").applyInPandas(chained, "part int, block int, state int")
    edits = F.element_at("ways", F.col("state") + 1).alias("edits")
    pieces = ways.join(entered, ["part", "block"]).select("conv_id", "part", "block", F.lit(-1).cast("long").alias("seq"), "found", "codes", "state", edits)
    stream = blocks.filter("seq >= 0").select("conv_id", "part", "block", "seq", "role", "text").unionByName(pieces, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "seq")

    def weave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations one after the other, each as a stream of blocks and rows."""
        key, counts, weaver, id_type = None, None, None, None
        digest, audit, kept, empty = hashlib.sha256(), [], [], True

        def put(lines: Iterator[str]) -> None:
            nonlocal empty
            for line in lines:
                digest.update(((b"" if empty else b"\n") + line.encode()))
                empty = False
                if texts:
                    kept.append(line)

        def done() -> pa.RecordBatch:
            put(weaver.finish())
            cells = [pa.array([key], id_type), *(pa.array([v], pa.int64()) for v in counts), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(cells + ([pa.array(["\n".join(kept)])] if texts else []), ["conv_id", *(c.split()[0] for c in fields.split(", "))])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, seq, role, text, codes, edits, state, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "role", "text", "codes", "edits", "state", "found"))):
                if seq >= 0:
                    put(weaver.push(role, text))
                    continue
                if found:  # the first block of a conversation
                    if weaver:
                        yield done()
                    key, counts, digest, audit, kept, empty = own, found, hashlib.sha256(), [], [], True
                else:
                    put(weaver.finish())
                weaver = Weaver(edits, codes, state)
                audit.append(edits)
        if weaver:
            yield done()

    fields = RESULT + (", repaired string" if texts else "")
    return stream.mapInArrow(weave, f"conv_id {kind}, {fields}")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults: by print of conversation and turn rows are dropped, emptied, cut off,
    repeated or given to the user."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("h", F.crc32(name) % 20).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, repaired after planted damage; one of which no row is left has zeros."""
    found = repair(damaged(conversations)).alias("f")
    every = conversations.select("conv_id").distinct().alias("e")
    rows = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zeros = [F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("e.conv_id", *zeros, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """DuckDB SQL of :func:`repair_report`: a forward programme over rows, one recursion step each, with the edits as texts."""
    white = r"[\x20\x09-\x0D]"
    then = lambda v, cost, letter, line="''": f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'o': {v}.o || {line}}} END"
    put = lambda v, name: then(v, INSERT, "I", f"chr(10) || '{name}:'")
    stays = "fault IN ('plain', 'truncated')"
    more = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    keep = lambda v, initial: f"CASE WHEN {stays} AND left(role, 1) = '{initial}' THEN {then(v, more, 'K', 'chr(10) || role || chr(58) || text')} END"
    name = lambda v, to: f"CASE WHEN {stays} THEN {then(v, f'{REROLE} + {more}', 'R', f'chr(10) || {chr(39)}{to}:{chr(39)} || text')} END"
    gone = lambda v: then(v, DELETE, "D")
    nothing = "{'c': 0, 'a': '', 'o': ''}"
    none = "NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR)"

    def free(source: str, *more: str) -> str:
        """States n0 to n3 of ``source``, with rows put in."""
        second = f"SELECT *, least(n2, {put('n0', 'user')}, {put('n1', 'user')}, {put('n3', 'user')}) AS t2 FROM ({source})"
        return f"SELECT {', '.join(more)}, n0 AS s0, n1 AS s1, t2 AS s2, least(n3, {put('t2', 'assistant')}) AS s3 FROM ({second})"

    step = f"""SELECT d.conv_id, d.i, {gone("s0")} AS n0, least({gone("s1")}, {keep("s0", "s")}) AS n1,
      least({gone("s2")}, {keep("s0", "u")}, {keep("s1", "u")}, {keep("s3", "u")}, {name("s0", "user")}, {name("s1", "user")}, {name("s3", "user")}) AS n2,
      least({gone("s3")}, {keep("s2", "a")}, {name("s2", "assistant")}) AS n3 FROM st JOIN d ON d.conv_id IS NOT DISTINCT FROM st.conv_id AND d.i = st.i + 1"""
    return f"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda l: ascii(l)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS h FROM conversations, tbl),
y AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM y),
d AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(regexp_replace(text, '{white}+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'plain' END AS fault FROM z),
first AS (SELECT conv_id, 0::BIGINT AS i, {nothing} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM (SELECT DISTINCT conv_id FROM d)),
st AS ({free("SELECT * FROM first", "conv_id", "i")} UNION ALL {free(step, "conv_id", "i")}),
ended AS (SELECT conv_id, least(arg_max(s0, i), arg_max(s3, i)) AS r FROM st GROUP BY conv_id),
seen AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM d) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(r.c, 0)::BIGINT AS cost, coalesce(r.a, '') AS audit, sha256(substr(coalesce(r.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN seen s ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ended ON e.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


ORACLE = _oracle()

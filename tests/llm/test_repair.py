import hashlib
import random
import re
import zlib
from functools import lru_cache

from trivet.llm import queries, repair

WORDY = re.compile(r"[^\x20\x09-\x0D]")
FORM = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def brute(rows):
    """Every sequence of edits of one conversation's rows (turn, role, text), by search."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = WORDY.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, put=0):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        name, to = NAMED[state]
        if put < 3:
            c, a, o = best(i, to, put + 1)
            ways.append((c + 2, "I" + a, (f"{name}:", *o)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, o = best(i + 1, state)
            ways.append((c + 3, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (state, role[:1]) in FORM:
                    c, a, o = best(i + 1, FORM[state, role[:1]])
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                c, a, o = best(i + 1, to)
                ways.append((c + 2 + more, "R" + a, (f"{name}:{text}", *o)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # shallow recursion
        for state in range(4):
            best(i, state)
    cost, audit, out = best(0, 0)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(spark, rows, **more):
    """The operator's rows against the search."""
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:9] for r in repair.repair(table, **more).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(groups)
    for conv, own in groups.items():
        assert got[conv] == brute(own), (conv, own)


def random_rows(seed, conversations=150, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "é…", "Fine!", "a:b\nc."]
    return [
        (conv if conv else None, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "ux", "", None]), rng.choice(texts))
        for conv in range(conversations)
        for _ in range(rng.randint(1, longest))
    ]


def test_random_conversations(spark):
    check(spark, random_rows(1))


def test_all_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "LONG_ROWS", 2)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 3)
    check(spark, random_rows(2, 60, 12))


def test_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 64)
    rng = random.Random(3)
    long = [(7, i // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "b", f"{i}.", f"{i}"])) for i in range(700)]
    check(spark, long + [(8, 1, "user", "same.")] * 300 + [(8, 2, "assistant", "ok")] + [(9, None, "assistant", "")] * 200)


def test_texts_extra_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5)], "conv_id long, turn long, role string, text string, audit string, part int")
    (row,) = repair.repair(rows, texts=True).collect()
    assert row.repaired == "user:Hi.\nassistant:" and row.audit == "KI" and row.cost == 2
    assert repair.repair(rows.limit(0)).count() == 0
    assert repair.repair_report(rows.limit(0)).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def test_query_equals_search(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        left = {conv: [] for conv, *_ in rows}
        for conv, *row in damage(rows):
            left[conv].append(tuple(row))
        got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, f"/root/testdata/{sf}").collect()}
        assert got == {conv: brute(own) for conv, own in left.items()}


def test_null_ids_and_lost_conversations(spark):
    rows = random_rows(5, 80, 2) + [(None, None, None, None), (None, 3, "user", "x")]
    left = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        left[conv].append(tuple(row))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(table).collect()}
    assert got == {conv: brute(own) for conv, own in left.items()} and not all(left.values())

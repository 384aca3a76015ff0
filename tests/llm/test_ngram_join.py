import random

import pytest

from trivet.llm import graph, ngram_join
from trivet.llm.shingles import shingle_sets


def sets_of(text, size=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    ws = [w for w in ws.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(rows, percent=80):
    sets = {i: sets_of(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    rows, i = [], 0
    for _ in range(60):  # families of near copies, many around the limit, a few large
        base = rng.choices(words, k=rng.choice([3, 5, 6, 12, 40, 90, 200]))
        for _ in range(rng.choice([1, 1, 2, 3, 45])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            rows.append((i, " ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws)))
            i += 1
    for _ in range(40):  # one passage in texts of their own
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(30, 50))) + "\n" + passage))
        i += 1
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "É É a\x0bb c\x85d é"), (5004, "É É A\x0cB C\x85D é"), (5005, passage + " tail"), (5006, passage)]


@pytest.mark.parametrize("seed,short,heavy", [(1, 16, 8), (2, 3, 2), (3, 2, 1)])
def test_components_equal_brute_force(spark, seed, short, heavy):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, sid string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs, short=short, heavy=heavy).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 1, None)], key=str)
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in up:
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_shingles_of_long_words_and_texts():
    a, b, c = (x[0] for x in shingle_sets(["x" * 100000, "y " * 50000, "x" * 99999 + "z"]))
    assert len(a) == len(b) == len(c) == 1 and len({int(a[0]), int(b[0]), int(c[0])}) == 3


@pytest.mark.parametrize("rounds", [10, 11, 12])
def test_words_that_sums_of_powers_confuse(spark, rounds):
    x, y = "a", "b"
    for _ in range(rounds):
        x, y = x + y, y + x
    rest = " c d e f"
    rows = [(1, x + rest), (2, y + rest), (3, x + rest)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_hubs_are_on_the_probing_side(spark):
    """A document of half of all pairs is ``a`` in each of them, and its partners are dealt into turns."""
    hub, n = b"h", 20 * ngram_join.PARTNERS
    rows = [(hub, b"p%d" % i) if i % 2 else (b"p%d" % i, hub) for i in range(n)] + [(b"p%d" % i, b"q%d" % i) for i in range(n)]
    got = ngram_join.oriented(spark.createDataFrame(rows, "a binary, b binary")).collect()
    assert sorted(sorted((bytes(r.a), bytes(r.b))) for r in got) == sorted(sorted(r) for r in rows)
    mine = [r for r in got if hub in (bytes(r.a), bytes(r.b))]
    assert all(bytes(r.a) == hub for r in mine)
    turns = {}
    for r in mine:
        turns[r.turn] = turns.get(r.turn, 0) + 1
    assert len(turns) == 20 and max(turns.values()) < 2 * ngram_join.PARTNERS and all(r.turn == 0 for r in got if bytes(r.a) != hub)

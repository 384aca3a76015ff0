import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from trivet.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, length=6, exponent=4):
    """Runs by each period's stretches of equal words, without those whose least period is smaller."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(length, exponent * q):
                found.setdefault((start, i + q - start), q)  # the least period of a stretch comes first
            i += 1
    return sorted((s, k, q) for (s, k), q in found.items() if not any(s2 <= s and s + k <= s2 + k2 and q2 < q and q % q2 == 0 for (s2, k2), q2 in found.items()))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_all_runs_of_short_texts():
    rng = random.Random(1)
    for _ in range(400):
        docs = [[rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.choice([0, 1, 2, 3, 8, 20, 40]))] for _ in range(rng.randint(0, 5))]
        names = {}
        flat = np.array([names.setdefault(w, len(names)) for d in docs for w in d], np.int64)
        text, start, length, period = runs.runs_of(flat, np.array([len(d) for d in docs], np.int64))
        got = list(zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()))
        assert got == [(i, s, k, q) for i, d in enumerate(docs) for s, k, q in sorted(brute(d, 2, 2), key=lambda r: (r[0], r[2]))]


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert sum(r[0] > 0 for r in got.values()) > 10
    for doc_id, text in docs.items():
        if len(WORD.findall(text or "")) < 3000:
            assert got[doc_id] == expected(doc_id, text), doc_id


def test_odd_rows(spark):
    texts = ["", None, " \t\n", "a", "a " * 6, "a b " * 4, "x" + " é" * 9 + " y z" * 5, "A a " * 30, "w\x1cw " * 8, "\x0bq\x0c" * 7, "r s t " * 2000 + "u"]
    rows = [(i, t, 1) for i, t in enumerate(texts * 3)] + [(4, texts[4], 2), (None, "k " * 8, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = runs.runs_report(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == expected(r.doc_id, (texts * 3)[r.doc_id]), r.doc_id
        else:
            assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 8, 1)
    assert runs.runs_report(table.limit(0)).count() == 0


def test_collapsed_and_looser_limits(spark):
    table = spark.createDataFrame([(1, "so  it goes it goes it goes on")], "doc_id long, text string")
    (row,) = runs.find_runs(table, least_length=4, least_exponent=2).collect()
    assert row.collapsed == "so it goes on" and [tuple(r) for r in row.runs] == [(1, 6, 2)] and row.n_words == 8

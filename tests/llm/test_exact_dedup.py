import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trivet.llm import exact_dedup, licenses, mixing


def test_groups_and_edge_cases(spark):
    long = "Word und mehr Text. " * 3000
    rows = [(1, long), (2, long.upper()), (3, long + "x"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "É"), (None, "É"), (9, "A b"), (9, "a B")]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, salt int, recipe string").repartition(4)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 8, 3, False), (7, 7, 1, True), (8, 8, 3, True), (None, 8, 3, False), (9, 9, 2, True), (9, 9, 2, True)]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_random_texts_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    alphabet = list("abMSTm st\n\t.É\u2028ß")
    pool = ["".join(rng.choice(alphabet, int(rng.integers(0, n)))) for n in (3, 40, 300, 2000, 9000) for _ in range(25)]
    texts = [pool[k].swapcase() if rng.random() < 0.3 else pool[k].upper() if rng.random() < 0.2 else pool[k] for k in rng.integers(0, len(pool), 400)]
    rows = [(int(rng.integers(0, 300)) if rng.random() < 0.95 else None, t) for t in texts] + [(k, "The same text. " * 200) for k in range(1000, 1300)]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids), len(ids) == 1 or (i is not None and i == best), hashlib.sha256(t.encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for more in ({}, {"min_chunk": 4, "max_chunk": 16, "salts": 3}):
        got = exact_dedup.exact_dedup(docs, **more).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_ambiguous_identifiers_are_noticed(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 200) for i in range(20)], "doc_id long, text string")
    weak = (lambda c: F.length(c).cast("long"), lambda c: F.sha2(c, 256))
    assert {r.group_size for r in exact_dedup.exact_dedup(docs, identifiers=weak).collect()} == {1}


def test_mixture_and_licences_on_odd_tables(spark):
    rows = [(i, "w " * (i % 5 + 1), "a" if i < 40 else "b") for i in range(60)] + [(100, None, None), (101, "", "c"), (None, "x y", "a"), (5, "w w", "a")]
    docs = spark.createDataFrame([(*r, 1.0, 9) for r in rows], "doc_id long, text string, source string, weight double, block int").repartition(3)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.copies >= 0 for r in got)
    assert min(r.copies for r in mixing.mix_sources(docs, mixing.Mixture(budget="cover")).collect()) >= 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.realise(docs, mixing.Mixture()).columns == docs.columns
    assert licenses.license_report(docs).count() == len(rows) and licenses.license_report(docs.limit(0)).count() == 0

import numpy as np
import pytest

from trivet.llm import kmeans_tree


def brute(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = sorted(((-kmeans_tree.exact_scores(np.array(v), np.array([w]))[0], j) for j, w in rows if j != i))
            out[i] = [(j, -s) for s, j in score[:k]]
    return out


def clustered(n, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32).astype(float)


def test_recall_and_scores_against_brute_force(spark):
    rows = list(enumerate(clustered(3000).tolist()))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want, got = brute(rows, 20), {}
    for r in kmeans_tree.nearest(docs, sample=1000, leaf=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    assert all(sorted(v) == list(range(1, 21)) for v in got.values())
    hits = sum(len({x[0] for x in want[q]} & {x[0] for x in got[q].values()}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    truth = {q: {j: s for j, s in brute([*rows], 3000)[q]} for q in [0, 20]}
    for q in truth:
        assert all(s == truth[q][j] for j, s in got[q].values())


def test_ties_copies_and_unusable_vectors(spark):
    base = [(i, [1.0, 0.0, 0.0]) for i in range(0, 100)] + [(i, [0.0, 1.0, float(i)]) for i in range(100, 121)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 0.0, 1.0]), (300, [1.0, 2.0]), (320, []), (None, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "a", 1) for i, v in base + bad], "vec_id long, embedding array<float>, leaf string, v int")
    got = {}
    for r in kmeans_tree.nearest(docs, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(base, 20)
    assert {q: [(j, s) for _, j, s in sorted(v)] for q, v in got.items()} == want


def test_few_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in kmeans_tree.nearest(docs).collect()] == [(0, 1, 1, 4.0)]
    assert kmeans_tree.nearest(docs.limit(0)).count() == 0
    assert kmeans_tree.nearest(docs.filter("vec_id = 1")).count() == 0


def test_recall_of_the_query_against_all_rows(spark):
    from trivet.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table if r.embedding is not None and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in queries.op10_nearest(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            scores = np.where(ids == q, -np.inf, vectors @ v)
            best = {int(i) for i in ids[np.lexsort((ids, -scores))[:20]]}
            hits, total = hits + len(best & got[q]), total + len(best)
    assert total == 20 * sum(i % 20 == 0 for i in ids.tolist()) and hits / total >= 0.9


def test_slices_of_visits_are_bounded():
    """A million visits of few queries: every one is there, in slices of bounded rows."""
    blocks = {leaf: leaf % 7 for leaf in range(400)}
    total, largest, pairs = 0, 0, set()
    for at, leaf, block in kmeans_tree.visiting_rows((range(400) for _ in range(850)), blocks):
        total, largest = total + len(at), max(largest, len(at))
        pairs |= {(x, b) for x, b in zip(leaf, block)}
        assert len(at) == len(leaf) == len(block)
    assert largest == 4096 and total == 850 * sum(blocks.values()) > 1_000_000
    assert pairs == {(x, b) for x, n in blocks.items() for b in range(n)}
    assert list(kmeans_tree.visiting_rows([], blocks)) == []

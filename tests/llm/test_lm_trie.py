import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trivet.llm import lm_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, mu):
    tokens = {i: WORD.findall(lower(t or "")) + ["\0end"] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c, c2, c1 = Counter(), Counter(), Counter()
    for i in train:
        c.update(tokens[i])
        c2.update(zip(["\0start", *tokens[i]], tokens[i]))
    c1.update({**c, "\0start": len(train)})
    n, v = sum(c.values()), len(c)
    out = {}
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = base
        for a, b in zip(["\0start", *ws], ws):
            score += math.log10((c2[a, b] / ((c[b] + 1) / (n + v + 1)) + mu) / (c1[a] + mu))
        out[i] = (len(ws), sum(c[w] > 0 for w in ws), n, base, score)
    return out


@pytest.mark.parametrize("salt", [lm_trie.SALT, 7])
def test_equals_brute_force(spark, salt):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(400, 0, -1) / 80200))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "A\tB c\x0bd É é"), (1003, "onlyhere " * 3000), (1004, "never seen w1 w2 w399 w398 w398"), (1005, "once w399 w399 w398")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, batch string, part int").repartition(5)
    got = {r.doc_id: r for r in lm_trie.lm_scores(docs, salt=salt, mu=30.0).collect()}
    want = brute(rows, 30.0)
    assert len(got) == len(rows)
    for i, (n, known, total, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-12)
        assert got[i].score == pytest.approx(score, abs=n / 500)


def test_words_that_sums_of_powers_confuse_and_long_texts(spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    rng = np.random.default_rng(2)
    rows = [(0, f"{x} {x} z"), (1, f"{y} z"), (3, " ".join(rng.choice(["p", "q", "r", x], 50_000)))]
    got = {r.doc_id: r for r in lm_trie.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), mu=30.0).collect()}
    for i, (n, known, total, base, score) in brute(rows, 30.0).items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-12) and got[i].score == pytest.approx(score, abs=n / 500)


def test_a_very_common_pair_is_a_few_entries_of_each_batch(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "hot pair " * 200 + " ".join(rng.choice(["hot", "pair", "x", "y"], 20))) for i in range(120)] + [(500 + i, "hot pair") for i in range(60)]
    texts = [t for _, t in rows]
    n = sum(len(t.split()) for t in texts)
    text = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    word = np.array([{"hot": 0, "pair": 1, "x": 2, "y": 3}[x] for t in texts for x in t.split()])
    held = np.arange(len(texts)) % 3 == 0
    own, parts, blobs = lm_trie.dealt_pairs(word[:-1], word[1:], np.ones(n - 1, np.uint16), text[:-1], np.zeros(n - 1, np.int64), held)
    few, often = lm_trie.unpack(blobs[0])[:5], lm_trie.unpack(blobs[0])[5:]
    assert parts == [0] and len(own[0]) == n - 1 - len(few[0]) and len(often[0]) <= 16 and len(few[0]) < 16 * lm_trie.REPEATED
    assert often[3].sum() == (~held[text[:-1]]).sum() - (~held[few[3]]).sum()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for repeated in (1, 4, 1 << 40):
        got = {r.doc_id: r for r in lm_trie.lm_scores(docs, mu=30.0, salt=50, repeated=repeated).collect()}
        for i, (tokens, known, total, base, score) in brute(rows, 30.0).items():
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, total)
            assert got[i].score == pytest.approx(score, abs=tokens / 500)


def test_repeated_rows_empty_table_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = lm_trie.lm_scores(docs, held=F.lit(False)).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {8}
    assert lm_trie.lm_scores(docs.limit(0)).count() == 0
    none = lm_trie.lm_scores(docs, held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in none)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(3)
    for values in (np.array([0]), np.array([5, 5, 5, 9]), np.sort(rng.integers(0, 1 << 40, 5000)), np.arange(1000)):
        ef = lm_trie.EliasFano(values)
        assert (ef.get(np.arange(len(values))) == values).all()
        probes = np.concatenate([values, values + 1, rng.integers(0, int(values[-1]) + 5, 500)])
        assert (ef.successor(probes) == np.searchsorted(values, probes)).all()
    pairs = np.unique(rng.integers(0, 50, (400, 2)), axis=0)
    every = np.array([(a, b) for a in range(52) for b in range(52)])
    have = {tuple(p) for p in pairs.tolist()}
    with lm_trie.Levels() as levels:
        codes = lm_trie.BigramTrie(pairs[:, 0], pairs[:, 1], 1 + pairs.sum(1) / 10, levels).code(every[:, 0], every[:, 1])
    assert [bool(k) for k in codes] == [tuple(e) in have for e in every.tolist()]
    assert np.allclose(codes[codes > 0] / lm_trie.STEP, 1 + every[codes > 0].sum(1) / 10, atol=1 / lm_trie.STEP)

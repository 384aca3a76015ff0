import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trivet.llm import mixing
from trivet.llm.mixing import Mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, mix):
    """``weights by source, copies of each row``: the exponent by plain bisection, the permutation by sorting."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    tokens, docs = Counter(), Counter()
    for n, (_, _, s) in zip(size, rows):
        tokens[s] += n
        docs[s] += 1
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    goal = total if mix.budget == "total" else mix.budget

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def bisect(low_side):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_side(weights(mid)) else (lo, mid)
        return lo

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    often = lambda w: max(w[s] * goal / tokens[s] for s in w)
    by_entropy = 1.0 if entropy(weights(1)) >= mix.entropy * math.log(len(share)) else bisect(lambda w: entropy(w) >= mix.entropy * math.log(len(share)))
    by_repetition = 0.0 if often(weights(0)) <= mix.repetition else bisect(lambda w: often(w) > mix.repetition)
    w = weights(max(by_entropy, by_repetition))
    copies, by_source = [0] * len(rows), defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by_source[s].append(i)
    for s, own in by_source.items():
        if not tokens[s]:
            for i in own:
                copies[i] = 1
            continue
        whole, rest = divmod(math.floor(w[s] * goal + 1e-6), tokens[s])
        blocks = max(1, docs[s] // mix.block_docs)
        block = {i: key(mix.seed, "block", rows[i][0]) % blocks for i in own}
        place = {i: (key(mix.seed, whole, s, block[i]), block[i], key(mix.seed, whole, rows[i][0])) for i in own}
        for i in own:
            spent = sum(size[j] for j in own if place[j] <= place[i])
            copies[i] = whole + (spent <= rest)
    return w, copies


@pytest.mark.parametrize("mix", [Mixture(block_docs=20), Mixture(entropy=0.999, repetition=1.5, block_docs=7, seed=5), Mixture(entropy=0.5), Mixture(budget=900, block_docs=10), Mixture(entropy=1.0, repetition=50.0, block_docs=30)])
def test_equals_brute_force(spark, mix):
    rng = np.random.default_rng(4)
    names = ["hot", "hot", "hot", "hot", "hot", "mid", "mid", "few", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 12))), names[rng.integers(len(names))]) for i in range(500)]
    rows += [(3, "again", "hot"), (3, "again", "hot"), (None, "no id", "hot"), (None, None, "mid"), (900, None, None), (901, "", "silent"), (902, "\t\n", "silent"), (903, "long " * 400, "hot"), (904, "É é x", "")]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, source string, weight long, plan_source string").repartition(5)
    weight, copies = brute(rows, mix)
    want = Counter((i, s, len(WORD.findall(t or "")), n) for (i, t, s), n in zip(rows, copies))
    got = mixing.mix_sources(docs, mix).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.copies) for r in got) == want
    assert all(r.weight == pytest.approx(weight.get(r.source, 0.0), abs=1e-9) for r in got)
    taken = Counter(r.weight for r in mixing.realise(docs, mix).collect())  # the user's column, a row number here
    assert taken == Counter({i: n for i, n in enumerate(copies) if n})

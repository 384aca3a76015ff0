import random
import unicodedata
import zlib
from collections import Counter

from trivet.llm import language


def grams(text):
    """N-grams of letters; a space may begin or end one."""
    low = []
    for c in f" {text} ":
        if unicodedata.category(c)[0] == "L":
            x = c.lower()
            low.append(x if len(x) == 1 else c)
        else:
            low.append(" ")
    out = []
    for n in language.SIZES:
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            inner = g[1:-1] if n > 2 else []
            if all(x != " " for x in inner) and any(x != " " for x in g[:2]):
                out.append("".join(g))
    return out


def brute(rows, share=0.25):
    """Exact sets in the place of the filter."""
    learn = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {}
    for t, lang in learn:
        counts.setdefault(lang, Counter()).update(grams(t))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    top = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[lang])
    sets = {lang: {g for g, n in c.items() if n >= 2 and n / total[lang] >= share * top[g]} for lang, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        own = grams(t or "")
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out[i] = ("und", 0.0, 1.0)
            continue
        parts = sorted(((sum(g in s for g in own) / len(own), lang) for lang, s in sets.items()), key=lambda x: (-x[0], x[1]))
        out[i] = (parts[0][1], parts[0][0], parts[0][0] - parts[1][0])
    return out


def corpus(languages, per=12, seed=1):
    """Made-up languages: each has letters and syllables of its own."""
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x3B1, 0x3CA)]]
    rows, i = [], 0
    for k in range(languages):
        own = rng.sample(letters, 9)
        words = ["".join(rng.choices(own, k=rng.randrange(2, 7))) for _ in range(25)]
        for _ in range(per):
            rows.append((i, " ".join(rng.choices(words, k=rng.randrange(15, 40))).title(), f"l{k:03d}"))
            i += 1
    rows += [(i, None, "l000"), (i + 1, "", None), (i + 2, "12 34 !", "l001"), (i + 3, rows[0][1], None)]
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "x", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, found string, score double").repartition(4)
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (lang, score, margin) in want.items():
        assert abs(got[i].score - score) < 0.05, (i, got[i], want[i])
        assert margin < 0.05 or got[i].lang_pred == lang
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    return got


def test_equals_exact_sets(spark):
    check(spark, corpus(5, per=20))


def test_more_languages_than_a_mask_word_has_bits(spark):
    rows = corpus(130, per=9, seed=2)
    got = check(spark, rows)
    held = [(got[i].lang_pred, lang) for i, t, lang in rows if lang and t and got[i].held_out and any(c.isalpha() for c in t)]
    assert sum(a == b for a, b in held) / len(held) > 0.9 and len({a for a, _ in held}) > 100


def test_repeated_rows_null_ids_and_long_texts(spark):
    rows = corpus(3, per=15, seed=3)
    long = " ".join(t for _, t, lang in rows if lang == "l001" and t) * 200
    docs = spark.createDataFrame([*rows, (7, rows[0][1], "l000"), (7, rows[0][1], "l000"), (None, rows[20][1], "l001"), (9000, long, None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) + 4
    assert [r.lang_pred for r in got if r.doc_id == 9000] == ["l001"] and [(r.lang_pred, r.held_out) for r in got if r.doc_id is None] == [("l001", False)]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 7 and r.lang_pred == "l000"}) == 1

import hashlib
import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm import test_language as language_test
from tests.llm import test_ngram_join as join_test
from trivet.llm import language
from trivet.llm.common import cut as clean_cut

EN = "the cat and the dog are in the house of the old man who reads books every long evening with his friends by fire"
FR = "le chat et le chien sont dans la maison du vieil homme qui lit des livres chaque longue soirée avec ses amis près du feu"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus(spark):
    rows = []
    for i in range(40):
        words = (EN if i % 2 else FR).split()
        text = " ".join(words[i % len(words) :] + words[: i % len(words)] + [f"{w}{'xyz'[i % 3]}" for w in words[: i % 7 + 3]])
        rows.append((i, text, "en" if i % 2 else "fr", "a" if i < 30 else "b", len(text)))
    rows += [(100, rows[0][1].translate({c: c - 32 for c in range(97, 123)}), "fr", "a", 0), (101, rows[3][1] + " more", "en", "b", 0)]
    rows += [(200, None, "en", "a", 0), (201, "", None, None, 0), (202, "12345 !!! 67", "en", "a", 0), (203, "ꙮꙮꙮꙮ ꙮꙮꙮꙮꙮ ꙮꙮ", None, "a", 0)]
    return docs_of(spark, rows)


def test_stages_keep_clean_documents_and_drop_the_rest(spark):
    docs = corpus(spark)
    kept = [r.doc_id for r in cp.keep_language(spark, docs, "").collect()]
    assert sorted(kept) == [*range(40), 100, 101]
    stage = cp.drop_copies(spark, cp.keep_language(spark, docs, ""), "")
    assert stage.columns == docs.columns
    left = {r.doc_id for r in stage.collect()}
    assert 100 in left and 0 not in left and {3, 101} <= left
    near = {r.doc_id for r in cp.drop_near_copies(spark, stage, "").collect()}
    assert 3 in near and 101 not in near
    mixed = [r.doc_id for r in cp.mix(spark, docs.filter("doc_id < 40"), "").collect()]
    assert set(mixed) == set(range(40)) and len(mixed) >= 40
    assert cp.encode(spark, docs, "").count() == docs.count()


def test_language_edge_cases(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(40))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert got[203].lang_pred in ("en", "fr") and got[203].score < cp.LEAST_SCORE
    none = docs.limit(0)
    assert language.fit(none) is None and language.identify(none, None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_every_stage_takes_an_empty_table(spark):
    docs = corpus(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_keep_one_of_the_copies_without_an_id(spark):
    a, b, c, d = EN, FR, "one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold teal"
    rows = [(None, a), (None, a.upper()), (None, a), (None, b), (7, b), (None, c), (8, d), (8, d), (9, d), (8, a + " twice")]
    docs = docs_of(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = sorted(((r.doc_id or 0, r.text.lower()) for r in cp.drop_copies(spark, docs, "").collect()))
    assert got == sorted([(0, a.lower()), (7, b), (0, c), (9, d), (8, a + " twice")])
    near = docs_of(spark, [(i, t, "en", "a", 0) for i, t in [(None, a), (None, a + " more"), (None, a + " yet more"), (None, b), (7, b + " encore"), (None, c), (None, c), (None, d), (1, c + " z" * 40), (1, b + " si")]])
    left = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, near, "").collect()]
    assert [i for i, t in left if t.startswith(a)] == [None]
    assert sorted(t for i, t in left if i is not None) == sorted([c + " z" * 40, b + " si"])
    assert sorted(t for i, t in left if i is None and not t.startswith(a)) == sorted([c, d])


def test_run_equals_stages_by_brute_force(spark, tmp_path):
    """Kept documents by exact sets of n-grams, equal texts and all pairs of shingle sets; codes by the library."""
    rng = random.Random(12)
    base = [(i, t, lang, "ab"[i % 2]) for i, t, lang in language_test.corpus(4, per=14, seed=4) if t]
    rows = [*base, (500, None, "l000", "a"), (501, "!!! 12", "l001", "b"), (502, "ꙮꙮꙮ ꙮꙮꙮꙮ", None, "a")]
    for k in range(0, 40, 5):  # copies in other case, and copies with a word more
        i, t, lang, source = base[k]
        rows += [(600 + k, t.upper(), lang, source), (700 + k, f"{t} {rng.choice(t.split())}", lang, "c")]
    docs_of(spark, [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()

    found = language_test.brute([(i, t, lang) for i, t, lang, _ in rows])
    assert all(abs(score - cp.LEAST_SCORE) > 0.05 for lang, score, _ in found.values() if lang != "und")
    kept = [r for r in rows if found[r[0]][0] != "und" and found[r[0]][1] >= cp.LEAST_SCORE]
    last = {}
    for i, t, _, _ in sorted(kept):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)] = i
    texts = {i: t for i, t, _, _ in kept if i in set(last.values())}
    root = {i: component for i, (_, component) in join_test.brute(list(texts.items())).items()}
    left = {i: t for i, t in texts.items() if root[i] == i}
    assert {r.doc_id for r in got} == set(left) and 502 not in left and len(left) < len(texts) < len(kept) < len(rows)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source = {r[0]: r for r in rows}
    docs = docs_of(spark, [(i, t, source[i][2], source[i][3], len(t)) for i, t in left.items()])
    copies = Counter(r.doc_id for r in cp.mix(spark, docs, "").collect())
    assert Counter(r.doc_id for r in got) == copies and min(copies.values()) >= 1
    for r in got:
        ids = tok.encode(left[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns_of_any_name(spark):
    """Values of columns that helpers might use come back as they were."""
    names = ["id", "own", "row", "_id", "_own", "_print", "_found", "found", "block", "n"]
    base = corpus(spark).filter("doc_id < 12 OR doc_id IN (100, 200)")
    null = base.filter("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))
    docs = base.unionByName(null)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.md5(F.coalesce("text", F.lit("")))))
    docs = docs.withColumn("more", F.create_map(F.lit("k"), F.col("text")))
    for _, stage in cp.STAGES[:-1]:
        docs = clean_cut(stage(spark, docs, ""))
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names, "more"] and len(rows) >= 10
        for r in rows:
            own = hashlib.md5((r.text or "").encode()).hexdigest()
            assert all(r[name] == f"{name}:{own}" for name in names) and r.more == {"k": r.text}
    assert cp.encode(spark, docs, "").count() == docs.count()

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from trivet.llm import bpe_words

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   ", "Hello, World's 12 dogs!", "<|endoftext|> and <|ENDOFTEXT|> <|startoftext|>x", "H\u0331 ΟΔΟΣ İstanbul e\u0301té", "a\x1cb\x1d c\x85d\xa0e\u2003f", "日本語 🙂 ½ Ⅷ ²", "it's we'll I'VE 'sx", "same text", "same text", "x" * 5000 + " " + "12.5% " * 300]


def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def same(spark, rows, parts=3):
    """Every row equals what the library gives for its text; ids may repeat or be null."""
    tok = library()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, batch int").repartition(parts)
    want = []
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False)
        decoded = tok.decode(e.ids, skip_special_tokens=False)
        want.append((i, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), e.ids, decoded))
    got = [tuple(r) for r in bpe_words.encode_decode(docs, PATH, texts=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equals_the_library(spark):
    same(spark, [*enumerate(TEXTS), (None, "null id"), (None, None), (3, "Hello, World's 12 dogs!"), (3, "another text of this id")])


def test_random_texts(spark):
    rng = random.Random(4)
    letters = "abcdeXYZ   \t\n0123.,!?'-_ÄßéΣσ日本한🙂\x1c\x85\u200b\u0301½²<|endoftext|>"
    same(spark, [(i, "".join(rng.choices(letters, k=rng.randrange(0, 200)))) for i in range(300)])


def test_words_that_sums_of_powers_confuse_and_long_texts(spark):
    x, y, rows = "a", "b", []
    for k in range(12):
        x, y = x + y, y + x
        rows += [(2 * k, x), (2 * k + 1, y)]
    rng = random.Random(5)
    same(spark, [*rows, (90, " ".join(rng.choices(["one", "two", "thr33", x[:300]], k=60_000)))])


def test_empty_table_and_decode(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_words.encode_decode(docs, PATH).count() == 0
    coded = spark.createDataFrame([(1, [320, 1125]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe_words.decode(coded, PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).decode([320, 1125], skip_special_tokens=False), 2: "", 3: ""}

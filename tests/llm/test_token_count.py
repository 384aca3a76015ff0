import random

import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trivet.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "   \n\n  x", "it's we'll I've 'tis ''s", "<|endoftext|>", " <|endoftext|>  a<|endoftext|", "日本語 🙂 ½ Ⅷ ² é é", "a" * 3000, " " * 500 + "b", "1234567890 12 3", "\x1c\x1d \x85\xa0  x", "x\ty\r\nz", "Hello world! " * 400]


def counts(spark, texts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    return {r.doc_id: r for r in token_count.count_tokens(docs, PATH).collect()}


def test_hard_texts_equal_the_library(spark):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    got = counts(spark, HARD)
    for i, t in enumerate(HARD):
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 1024)
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), min_size=1, max_size=60))
def test_random_texts_equal_the_library(spark, texts):
    tok = Tokenizer.from_file(PATH)
    got = counts(spark, texts)
    assert [got[i].n_tokens for i in range(len(texts))] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_that_sums_of_powers_confuse(spark):
    tok = Tokenizer.from_file(PATH)
    texts = []
    for a, b in ("th", "er", "is"):
        x, y = a, b
        for _ in range(12):
            x, y = x + y, y + x
            texts += ["q" + x, "q" + y, f"q{x} q{y} q{x}"]
    got = counts(spark, texts)
    assert [got[i].n_tokens for i in range(len(texts))] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_in_a_small_window_and_long_texts_in_slices():
    tok = Tokenizer.from_file(PATH)
    tables = token_count.load(PATH)
    counter = token_count.PieceCounts(tables["vocab"], tables["parts"], tables["merges"], most=500)
    rng = random.Random(6)
    for _ in range(4):
        piece = "".join(rng.choices("etaoinshrdluabc", k=4000)) + "abab" * 300
        assert counter(piece.encode()) == len(tok.encode(piece, add_special_tokens=False).ids)
        assert counter(b"hello") == 1
    live = (*token_count.piece_transducer(), counter)
    words = ["the", "cat", "it's", "12", "x.y", "<|endoftext|>", "É", "\n", "  "]
    texts = [" ".join(rng.choices(words, k=3000)), "short", " ".join(rng.choices(words, k=3000)), "a" * 5000]
    assert list(token_count.counts_of(texts, tables, live, chars=700)) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in token_count.count_tokens(docs, PATH).collect()), key=str) == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 5, 3, False), (None, 0, 0, False)], key=str)

"""Token counts of the compiled transducer against the tokenizer's library."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kairograph.llm import token_automaton as ta
from kairograph.llm.queries import QUERIES

pt = pytest.importorskip("public_tokenizers")
PATH = pt.path("word_bpe_49k.json")
PARTS = ["a", "b", "e", "th", "the", "ing", "'s", "'", "''", "'re", "'ll", "'l", "'D", "S", "T", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "1", "22", "½", "٣", "!", "..", "-", "é", "É", "é", "́", "İ", "ß", "Σ", "σς",
         "中", "日本", "😀", "👨‍", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "Å", "ﬁ", "Ǆ", "ͅ", "ا", "ำ", "_", "ʼ", "x" * 40, "aaaa" * 30, "lololo" * 50, "﻿", "\x00", "ẛ̣", "가"]


@pytest.fixture(scope="module")
def counter():
    return ta.TokenCounter(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def wanted(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_is_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    n = dict(zip(texts, wanted(library, texts.values())))
    rows = QUERIES["op11_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts) and all((r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n[r.doc_id], n[r.doc_id] > 2048) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=25))
def test_any_text(counter, library, parts):
    text = "".join(parts)
    assert counter.counts([text, None, "", text + " x"]).tolist() == wanted(library, [text, None, "", text + " x"])


def test_long_words_are_composed_over_chunks(counter, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeth") for _ in range(5000)) for _ in range(10)] + ["ab" * 4000, "a" * 10_001, "thethethe" * 900, "".join(rng.choice("aeithsn") for _ in range(6000)) + " end"]
    assert counter.counts(texts).tolist() == wanted(library, texts)
    symbols, _ = counter.symbols(np.concatenate([counter._characters(t + " ") for t in texts]))
    whole = counter.machine.gains(symbols, 1 << 20)
    for chunk in (5, 64, 300):
        assert (counter.machine.gains(symbols, chunk) == whole).all()


def test_chunk_scan_mends_states_it_did_not_foresee(counter, monkeypatch):
    symbols, _ = counter.symbols(counter._characters("".join(random.Random(1).choice("athein") for _ in range(3000))))
    whole = counter.machine.gains(symbols, 1 << 20)
    for foreseen in ((1,), (2, 3), tuple(range(16, 32))):
        monkeypatch.setattr(ta, "FORESEEN", foreseen)
        assert (counter.machine.gains(symbols, 16) == whole).all()


def test_small_tables_and_pieces(library, monkeypatch):
    small = ta.TokenCounter(PATH, max_states=200)
    monkeypatch.setattr(ta, "GROUP_CHARS", 500)
    monkeypatch.setattr(ta, "PIECE_CHARS", 40)
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert small.counts(texts).tolist() == wanted(library, texts)


def test_vocabulary_without_word_ends():
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "bc": 4, "abc": 5, "aa": 6}
    m = ta.Transducer(vocab, [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "a"]], "")
    word = "aababcbcaaab"
    symbols = np.array([ord(c) for c in word[:-1]] + [ord(word[-1]) + ta.END], np.int16)
    assert m.gains(symbols, 3).sum() == len(m.encode([ord(c) for c in word]))


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "It's 2 o'clock"), (3, "It's 2 o'clock"), (None, "é <|endoftext|> x"), (4, "word " * 300_000), (5, "zq" * 200_000), (6, "  \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("own")).repartition(3)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in ta.count_tokens(docs, PATH).collect()))
    n = wanted(library, [t for _, t in rows])
    assert got == sorted((i or 0, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n))
    assert ta.count_tokens(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        ta.TokenCounter(pt.path("byte_bpe_50k.json"))

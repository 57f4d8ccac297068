from functools import lru_cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chartlode.llm import queries
from chartlode.llm import token_counts as tc

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


@lru_cache
def library(name):
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    return lambda text, whole=Tokenizer.from_file(public_tokenizers.path(name)): whole.encode(text, add_special_tokens=False).ids


def plain(name, text):
    return len(library(name)(text))


def count(name, texts):
    of_text, of_rest, cut = tc.counter(public_tokenizers.path(name))
    return tc.counted(texts, tc.Lengths(of_text), tc.Lengths(of_rest), cut).tolist()


ODD = ["", " ", "  two  spaces ", "a \n b", " lead", "trail ", "x<|endoftext|> y", "x <|endoftext|>", "<|endoftext|>" * 3, "it's a' s I'LL", "naïve café é ́ x", "東京 は 🙂 ok", "tab\t tab \t x", "a  b  c", "ὀδός Σ σ ς ", "1 2  3   4", "x" * 5000, "ab " * 3000, "\u0085 x ​ y﻿ z"]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("stretch", [8, 1 << 17])
def test_odd_texts_count_as_the_library_counts_them(name, stretch, monkeypatch):
    monkeypatch.setattr(tc, "STRETCH", stretch)
    monkeypatch.setattr(tc, "BATCH_BYTES", 100)
    monkeypatch.setattr(tc, "REMEMBERED", 500)
    assert count(name, ODD * 2) == [plain(name, t) for t in ODD] * 2


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\ta'sé|<>1Σя東"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_counts_as_the_library_counts_it(text):
    for name in FILES:
        assert count(name, [text]) == [plain(name, text)]


def test_which_files_allow_a_cut():
    assert [tc.counter(public_tokenizers.path(n))[2] for n in FILES] == [True, False, True]


def test_operator_on_odd_rows(odd, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tc.token_counts(odd, path, limit=100).collect()
    want = [(str(d), len((t or "").encode()), n := plain("byte_bpe_50k.json", t or ""), n > 100) for d, t, *_ in texts]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert tc.token_counts(empty, path).count() == 0


def test_query(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(str(d), len((t or "").encode()), n := plain("byte_bpe_50k.json", t or ""), n > 512) for d, t, *_ in texts]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)

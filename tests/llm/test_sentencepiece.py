import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from veripaper.llm.queries import QUERIES
from veripaper.llm.sentencepiece_bpe import Model, sentencepiece_encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = Model(PATH)

ODD = ["", None, " ", "   a  b ", "▁x ▁▁ y", "a\tb\n\nc\r", "hello <s> </s> <unk> <0x41>", "日本語 テキスト", "\u0000​﻿ x",
       "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "𝒳 🎉🎉👩‍👩‍👧", "x" * 3000, " " * 100, "ééé é", "1234567890 " * 300, "thththththt ererererer"]


def by_library(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def same(text):
    ids, decoded = MODEL.encode(text or "")
    expected, text_back = by_library(text)
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert decoded == text_back


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinorsth ▁'éß\n1", max_size=120))
def test_dense_text(text):
    same(text)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op9_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = by_library(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "word " * 50000, 3)], "doc_id long, text string, ids int")
    rows = sentencepiece_encoded(docs, PATH).collect()
    assert sorted(r["n_tokens"] for r in rows)[:2] == [2, 2] and len(rows) == 4
    for r in rows:
        assert r["decoded"] == by_library(LIBRARY.decode(r["ids"]))[1]
    assert sentencepiece_encoded(docs.where("false"), PATH).count() == 0

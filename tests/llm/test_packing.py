import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veripaper.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 40), max_size=60))
def test_plan_uses_every_piece_once(counts):
    used = Counter()
    for pattern in P.packing_plan(counts):
        assert sum(pattern.lengths) <= P.WINDOW and pattern.times > 0
        for length in pattern.lengths:
            used[length] += pattern.times
    assert used == Counter(counts)


def test_plan_pads_little():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2047, rng.lognormal(6, 1, 20000).astype(int) + 1)
    plan = P.packing_plan(dict(Counter(lengths.tolist())))
    sequences = sum(p.times for p in plan)
    assert lengths.sum() / (sequences * P.WINDOW) > 0.995


def test_least_squares():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 30)), np.maximum(0, rng.normal(size=30))
    found = P.non_negative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6


ODD = ["", None, " \n\t ", "It's WE'LL don't 'sx a'b", "<|endoftext|> x<|startoftext|>y", "café ́x", "a b c\x1cd",
       "ΣΑΣ ΟΔΟΣ", "12345 1.5e3", "!!??\u0000", "word " * 5000, "日本語 テキスト", "x" * 9000, "\u0085a b"]


def checked(pieces, texts):
    """All ids of every document, once, and gapless sequences within the window."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, rows in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [P.END_ID], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.WINDOW
    return len(by_sequence)


def test_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("*", "1 as length", "'x' as ids")
    checked(P.packed(docs, PATH).collect(), dict(enumerate(ODD)))
    with_ids = P.packed(docs, PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)
    assert P.packed(docs.where("false"), PATH).count() == 0


def test_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED", 7)
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "same")] + [(2, "same text")] * 40, "doc_id long, text string")
    rows = P.packed(docs, PATH).collect()
    assert len(rows) == 43 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 43


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = P.packed(docs, PATH).collect()
    n_sequences = checked(rows, texts)
    assert sum(r["length"] for r in rows) / (n_sequences * P.WINDOW) > 0.97

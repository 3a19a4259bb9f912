"""Repeated windows of words and bytes against brute force."""

import random
import re

import pytest

from veripaper.llm import repeats
from veripaper.llm.substring_dedup import substring_dedup
from veripaper.llm.suffix_dedup import suffix_array_dedup

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words_by_hand(texts, window):
    seen, out = {}, {}
    for doc in sorted(texts):
        for i, w in enumerate(windows(WORD.findall(texts[doc] or ""), window)):
            seen.setdefault(w, doc)
    for doc, text in texts.items():
        w = WORD.findall(text or "")
        gone = {i + k for i, x in enumerate(windows(w, window)) if seen[x] < doc for k in range(window)}
        out[doc] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def windows(items, n):
    return [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]


def bytes_by_hand(texts, n):
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            piece = data[i : i + n]
            if piece in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[doc] = (len(data), sum(gone), spans, kept)
    return out


def corpus(seed):
    """Texts that share passages of many lengths around the window, with edges in all places, and periodic ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["la", "tion", "é", "wh", "thing", "ß", "a", "re"]) + str(rng.randrange(400))
    passages = [[word() for _ in range(rng.choice([8, 20, 30, 60]))] for _ in range(6)]
    texts = {}
    for doc in range(60):
        words = []
        for _ in range(rng.randrange(0, 6)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            if rng.random() < 0.4:
                p = p[rng.randrange(len(p)) :]
            words += p + [word() for _ in range(rng.randrange(0, 5))]
        texts[doc] = rng.choice([" ", "\n"]).join(words)
    texts |= {60: None, 61: "", 62: "ab " * 300, 63: "a" * 500, 64: "ab " * 100 + "x", 65: "a" * 99, 66: "\u0085x y", 67: texts[3], 68: texts[3]}
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as doc", "2 as start").repartition(4)
    found = substring_dedup(docs, window=12, gram=6).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found} == words_by_hand(texts, 12)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as doc", "2 as start").repartition(4)
    found = suffix_array_dedup(docs).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept_bytes"])) for r in found}
    assert got == bytes_by_hand(texts, 100)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert found == [(-1, 0, 0), (-1, 120, 0), (1, 120, 0), (1, 120, 0), (2, 120, 120)]
    n = len(text)
    found = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_array_dedup(docs).collect())
    assert found == [(-1, 0, 0), (-1, n, 0), (1, n, 0), (1, n, 0), (2, n, n)]
    for operator in (substring_dedup, suffix_array_dedup):
        assert operator(docs.where("false")).count() == 0
        carried = operator(docs.selectExpr("*", "3 as n_removed"), carry=True)
        assert carried.select("row.*").columns == ["doc_id", "text", "n_removed"]


def test_copies_of_an_open_passage_make_no_windows(spark, monkeypatch):
    """Only the first of equal passages is looked at window by window, however often a document repeats it."""
    rng = random.Random(5)
    a, b, c, d, shared = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150)) for _ in range(5))
    counts = []

    def counted(df, before=repeats.written):
        out = before(df)
        if "one" in out.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(repeats, "written", counted)
    for copies in (2, 40):
        texts = {1: (a + shared + b) * copies, 2: c + shared + d}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        found = suffix_array_dedup(docs).collect()
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept_bytes"])) for r in found}
        assert got == bytes_by_hand(texts, 100)
    assert 0 < counts[1] <= 2 * counts[0]

import random

import numpy as np
import pyarrow as pa
import pytest

from veripaper.llm import line_dedup as L
from veripaper.llm.shared import small_batches


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    line = bytearray(line)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(line) + 1)
        if kind == 0:
            line.insert(at, rng.choice(b"abc"))
        elif at < len(line) and kind == 1:
            del line[at]
        elif at < len(line):
            line[at] = rng.choice(b"abc")
    return bytes(line)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within(edits):
    rng = random.Random(edits)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 16)))
        b = edited(rng, a, rng.randrange(0, 6))
        assert L.within(a, b, edits) == (distance(a, b) <= edits)


def by_hand(texts, edits, shortest):
    lines = [(d, n, x.strip(b" \t\n\v\f\r")) for d, t in sorted(texts.items()) for n, x in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for d, n, x in lines:
        first.setdefault(x, (d, n))
    near = {x: [y for y in first if x != y and min(len(x), len(y)) >= shortest and distance(x, y) <= edits] for x in first}
    out = {}
    for doc, text in texts.items():
        own = [(n, x) for d, n, x in lines if d == doc]
        copies = {n for n, x in own if first[x] != (doc, n)}
        gone = copies | {n for n, x in own if any(first[y] < (doc, n) for y in near[x])}
        links = sum(len(near[x]) for n, x in own if n not in copies)
        kept = b"\n".join(x for n, x in enumerate((text or "").encode().split(b"\n")) if n not in gone).decode()
        out[doc] = (len(own), len(copies), len(gone), links, kept)
    return out


def test_lines(spark):
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 40))) for _ in range(25)]
    texts = {}
    for doc in range(40):
        lines = [edited(rng, rng.choice(base), rng.randrange(0, 5)).decode() for _ in range(rng.randrange(0, 7))]
        lines += rng.choice([[], [""], ["  \t"], [" é" * 15], ["é" * 15 + "x"]])
        texts[doc] = "\n".join(lines)
    texts |= {40: None, 41: "", 42: "\n\n", 43: "y" * 500, 44: "y" * 501, 45: texts[1]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as doc", "2 as gone").repartition(3)
    found = {r["doc_id"]: (r["n_lines"], r["n_copies"], r["n_removed"], r["n_links"], r["kept_text"]) for r in L.line_dedup(docs).collect()}
    assert found == by_hand(texts, L.EDITS, L.SHORTEST)


def test_long_lines(spark):
    texts = {1: "y" * 50000, 2: "y" * 50001, 3: "y" * 50003 + "\nz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_links"], r["kept_text"]) for r in L.line_dedup(docs).collect()}
    assert found == {1: (1, 0, 1, texts[1]), 2: (1, 1, 2, ""), 3: (2, 1, 1, "z")}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "one line\nx"), (1, "one line\nx"), (None, "one line"), (2, "one line"), (None, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or -1, r["n_lines"], r["n_removed"], r["kept_text"]) for r in L.line_dedup(docs).collect())
    assert found == [(-1, 0, 0, ""), (-1, 1, 0, "one line"), (1, 2, 0, "one line\nx"), (1, 2, 0, "one line\nx"), (2, 1, 1, "")]
    assert L.line_dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_pairs(edits, monkeypatch):
    monkeypatch.setattr(L, "LONG", 14)
    monkeypatch.setattr(L, "CELLS", 300)
    rng = random.Random(edits)
    pairs = []
    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 17)))
        pairs.append((a, edited(rng, a, rng.randrange(0, 6)) or b"a"))
    size = np.array([[len(a), len(b)] for a, b in pairs])
    begin = (np.cumsum(size) - size.ravel()).reshape(size.shape)
    data = np.frombuffer(b"".join(a + b for a, b in pairs), np.uint8)
    found = L.near_pairs(data, begin[:, 0], size[:, 0], begin[:, 1], size[:, 1], edits)
    assert found.tolist() == [distance(a, b) <= edits for a, b in pairs]


def test_family_of_near_lines(spark, monkeypatch):
    """Links of a family are counted in blocks of its lines; pairs are never rows."""
    monkeypatch.setattr(L, "BLOCK_ROWS", 16)
    monkeypatch.setattr(L, "PAIRS", 100)
    monkeypatch.setattr(L, "CELL_BYTES", 2000)
    rng = random.Random(9)
    base = bytes(rng.choice(b"abc") for _ in range(40))
    texts = {doc: "\n".join(edited(rng, base, rng.randrange(0, 3)).decode() for _ in range(3)) for doc in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    result = L.line_dedup(docs)
    found = {r["doc_id"]: (r["n_lines"], r["n_copies"], r["n_removed"], r["n_links"], r["kept_text"]) for r in result.collect()}
    assert found == by_hand(texts, L.EDITS, L.SHORTEST)
    lines = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc long, text string")
    firsts = spark.createDataFrame([(d, n) for d in texts for n in range(3)], "doc long, line int")
    assert L._near(lines, firsts, L.EDITS, L.SHORTEST).columns == ["doc", "line", "links", "least"]


def test_batches_of_a_given_size():
    """Texts are dealt by bytes: a batch ends with the text that fills it."""
    texts = ["a" * 40, None, "é" * 20, "b" * 300, "c", "d" * 99]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(6))})
    found = [(part.column("n").to_pylist(), data.tobytes().decode(), starts.tolist()) for part, data, starts in small_batches([batch], "text", size=100)]
    assert found == [
        ([0, 1, 2, 3], "a" * 40 + "é" * 20 + "b" * 300, [0, 40, 40, 80, 380]), ([4, 5], "c" + "d" * 99, [0, 1, 100]),
    ]


def test_copies_of_repeated_rows(spark):
    """Rows that repeat a document count once, also where another text has the same identifier."""
    rows = [(1, "one\ntwo\none"), (1, "one\ntwo\none"), (2, "two\nthree"), (2, "two\nthree"), (3, "three\nfour\nthree"), (None, "one")]
    found = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_copies"], r["n_removed"], r["kept_text"]) for r in found)
    assert got == [
        (-1, 1, 0, 0, "one"), (1, 3, 1, 1, "one\ntwo"), (1, 3, 1, 1, "one\ntwo"), (2, 2, 1, 1, "three"), (2, 2, 1, 1, "three"),
        (3, 3, 2, 2, "four"),
    ]

import random

import numpy as np
import pytest

from veripaper.llm import near_dedup as N



def by_hand(texts):
    """Component of every document by comparing all pairs of whole sets."""
    import re

    sets, best = {}, {}
    for doc, text in texts.items():
        w = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
        best[doc] = doc

    def root(d):
        while best[d] != d:
            d = best[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                best[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(rng, n, words, changed):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(words), changed):
            copy[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small, levels", [(1000, 3), (8, 2), (5, 0)])
def test_components(spark, monkeypatch, small, levels):
    """Groups well inside, around and outside of the threshold, with nodes that branch and nodes that are dealt out."""
    monkeypatch.setattr(N, "SMALL_NODE", small)
    monkeypatch.setattr(N, "LEVELS", levels)
    rng = random.Random(3)
    texts = [t for args in ((40, 200, 1), (30, 200, 4), (30, 120, 4), (10, 60, 5), (2, 6, 0)) for t in near_copies(rng, *args)]
    texts += ["", None, "one two", "ONE two", "a b c d e", "A b C d e", "a b c d e f", "solo " * 30000]
    rng.shuffle(texts)
    table = dict(enumerate(texts))
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").selectExpr("*", "1 as key", "'x' as kept")
    found = {r["doc_id"]: r for r in N.near_dedup(docs).collect()}
    expected = by_hand(table)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == expected
    assert all(r["kept"] == (r["component_id"] == d) for d, r in found.items())


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None), (3, "a b c d e f")]
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in out) == [
        (-1, 0, -1, True), (-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)]
    assert N.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_shingles():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(20)]
    expected = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert N.common_shingles(sets).astype(int).tolist() == expected


def test_packed_sets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        shingles = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (N.unpacked_set(N.packed_set(shingles)) == shingles >> np.uint64(24)).all()

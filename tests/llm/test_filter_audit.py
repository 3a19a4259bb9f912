import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veripaper.llm import filter_audit as A

WORDS = " ".join(f"w{i}" for i in range(120))
TEXTS = ["", None, WORDS, WORDS, WORDS + " $", WORDS.upper(), "a b a b", "a " * 200, "É" * 7, "A\x1cB \n", "x" * 300 + "&"]


def failed_by_hand(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {
        f
        for f, fails in zip(
            "ABCD",
            (
                len(words) < 100,
                100 * len(set(words)) < 80 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                re.search("[#$%&*|]", text) is not None,
            ),
        )
        if fails
    }


def audit_by_hand(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    rank = lambda d: float("inf") if d is None else d
    for d, text, _ in docs:
        least[text or ""] = min(least.get(text or "", float("inf")), rank(d))
    rows = [
        (d, lang or "", failed_by_hand(text or "") | ({"E"} if rank(d) > least[text or ""] else set())) for d, text, lang in docs
    ]
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(d, f) for d, p, f in rows if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                n_left, left = len(left), [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), n_left - len(left), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def found(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "'x' as good", "2 as n")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text")
    return {(r[0], r[1], r[2]): list(r[3:]) for r in A.filter_audit(frame, marks).collect()}


def test_odd_rows(spark):
    docs = [(i, t, ["en", None, ""][i % 3]) for i, t in enumerate(TEXTS)]
    docs += [(2, WORDS, "en"), (2, WORDS, "de"), (None, WORDS, "en"), (None, "only null " * 3, "de"), (None, "only null " * 3, "de")]
    labels = [(2, 1, 0), (2, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    assert found(spark, docs, labels) == audit_by_hand(docs, labels)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, None, None)]
    assert found(spark, docs, []) == audit_by_hand(docs, [])


def test_one_text_fills_the_table(spark):
    docs = [(i, WORDS if i % 2 else f"{WORDS} {i}", "en") for i in range(3000)] + [(7, WORDS, "en")] * 500
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 3000, 2)]
    assert found(spark, docs, labels) == audit_by_hand(docs, labels)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 1000)), max_size=60))
def test_popcount(pairs):
    words, times = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    expected = [sum(t for w, t in pairs if w >> b & 1) for b in range(32)]
    assert A.positional_popcount(A._planes(words.astype(np.uint32), times)).tolist() == expected


@pytest.mark.parametrize("block", [3, 1 << 22])
def test_long_text_in_blocks(block, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", block)
    for text in [t or "" for t in TEXTS] + ["ab " * 400 + "ÀB" * 90]:
        bits = A.failures(text.encode())
        assert {f for i, f in enumerate("ABCD") if bits >> i & 1} == failed_by_hand(text)

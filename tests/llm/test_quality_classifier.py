import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veripaper.llm import quality_classifier as Q

def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = Q.quality_scores(docs, labels, held())
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 5 and above > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_odd_rows(spark):
    texts = [None, "", " \n", "Calm words here.", "LOUD!! WORDS!! HERE!!", "calm again, and more.", "é" * 9, "x" * (3 * Q.PIECE)]
    docs = spark.createDataFrame([(i if i < 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3, "doc_id long, text string")
    docs = docs.selectExpr("*", "0 as quality", "1.5 as score", "'x' as good")
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (5, 0), (6, None), (6, 7), (None, 0)], "doc_id long, quality int")
    null = F.col("doc_id").isNull()
    rows = Q.quality_scores(docs, labels, null).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 11 and score[3] > 0.5 > score[4] and score[0] == score[1] and score[5] > score[4]
    assert [r["held_out"] for r in rows].count(True) == 1
    assert Q.quality_scores(docs.where("false"), labels, null).count() == 0
    for some, expected in (("false", 0.5), ("doc_id = 4", 0.0), ("doc_id = 3", 1.0)):
        assert {round(r["score"], 9) for r in Q.quality_scores(docs, labels.where(some), null).collect()} == {expected}


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=400), st.integers(300, 400))
def test_pieces_miss_nothing(text, size):
    text = b"ab cd!! " * 70 + text
    whole = set(Q.ngrams(text).tolist())
    kept, Q.PIECE = Q.PIECE, size
    try:
        assert {int(x) for x in Q.ngrams(text)} >= {int(x) for n in (2, 3, 4) for x in byte_runs(text, n)}
        assert whole >= {int(x) for n in (2, 3, 4) for x in byte_runs(text, n)}
    finally:
        Q.PIECE = kept


def byte_runs(text, n):
    numbers = [int.from_bytes(text[i : i + n], "big") for i in range(len(text) - n + 1)]
    return Q._hashed(np.array(numbers, np.uint64), n)


def hinge(weights, rows, signs, costs):
    return weights @ weights / 2 + sum(c * max(0, 1 - s * (weights[at] @ v)) for (at, v), s, c in zip(rows, signs, costs))


def test_descent_reaches_the_least_loss(monkeypatch):
    monkeypatch.setattr(Q, "PASSES", 400)
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(20, 6, replace=False)), rng.normal(size=6)) for _ in range(60)]
    signs, costs = rng.choice([-1.0, 1.0], 60), rng.uniform(0.2, 2, 60)
    weights = Q.dual_coordinate_descent(rows, signs, costs, 20)
    least = hinge(weights, rows, signs, costs)
    for _ in range(300):
        assert hinge(weights + rng.normal(size=20) * rng.choice([1e-3, 1e-2, 0.1]), rows, signs, costs) > least - 1e-3


def test_ratios():
    good, bad = np.zeros(Q.SIZE), np.zeros(Q.SIZE)
    good[5], bad[5], good[6], bad[7] = 9, 9, 9, 9
    ratios = Q.log_ratios(good, bad)
    assert abs(ratios[5]) < 1e-9 and np.isclose(ratios[6], np.log(10)) and np.isclose(ratios[7], -np.log(10))

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veripaper.llm import vector_search as S


def by_hand(rows, k):
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in good.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a))[:k]
            out |= {(q, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("blocks", [(2048, 1024), (16, 4)])
def test_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "VECTORS", blocks[0])
    monkeypatch.setattr(S, "QUERIES", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    rows += [(i, [0.5] * 8) for i in range(200, 320)]  # one very common vector
    rows += [(1000, None), (1001, []), (1002, [None] + [0.1] * 7), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, [0.1] * 8)]
    rows += [(2000 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(0, 11)] + [(3000, [1.0] * 5), rows[10], rows[10], rows[11]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v").repartition(4)
    found = {tuple(r) for r in S.top_k_search(vectors, F.col("id") % 10 == 0).collect()}
    assert found == by_hand(rows, 10)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    values = rng.integers(-600, 600, (300, 16)).astype(float)
    low, width = values.min(axis=0), np.maximum(1.0, (np.ptp(values, axis=0) + 1) / S.CELLS)
    cells = np.minimum(S.CELLS - 1, (values - low) // width)
    middle, reach = S.bounds(values[:20], cells, low, width)
    assert (np.abs(values[:20] @ values.T - middle) <= reach[:, None]).all()


def test_empty(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert S.top_k_search(vectors, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert S.top_k_search(alone, F.col("id") % 100 == 0).count() == 0

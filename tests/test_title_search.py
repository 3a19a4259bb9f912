"""A title search works on slices of its queries, so that what it notes does not grow with a group."""

import tracemalloc

import numpy as np

from veripaper.operators import matching as M


def searched(n, monkeypatch, some):
    for name, value in some.items():
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(6)
    sets = [np.unique((rng.random(9) ** 2 * 300).astype(np.int64)) for _ in range(n)]
    put = lambda some: (np.concatenate(some), np.array([len(s) for s in some]))
    search = M._Search(np.array([f"{i:032d}" for i in range(n)]).astype("S32"), *put(sets), 5)
    tracemalloc.start()
    for a, b in ((0, n // 10), (n // 10, n)):
        search.block(np.array([f"{i:032d}" for i in range(a, b)]).astype("S32"), np.ones(b - a, np.int64), *put(sets[a:b]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    result = search.result()
    rows = [r for batch in result for r in batch.to_pylist()]
    return [(r["_q"], r["_set"], r["overlap"]) for r in rows], most


def test_slices_find_the_same(monkeypatch):
    whole, _ = searched(900, monkeypatch, {"SLICE": 1 << 20, "PAIRS": 1 << 21})
    sliced, _ = searched(900, monkeypatch, {"SLICE": 70, "PAIRS": 500})
    assert whole == sliced and len(whole) > 900


def test_slices_take_less_memory(monkeypatch):
    _, whole = searched(6000, monkeypatch, {"SLICE": 1 << 20, "PAIRS": 1 << 16})
    _, sliced = searched(6000, monkeypatch, {"SLICE": 300, "PAIRS": 1 << 16})
    assert sliced < whole * 0.8

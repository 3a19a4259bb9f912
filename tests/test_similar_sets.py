"""The join of trigram sets against all pairs, with blocks so small that sets of one size are in several."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veripaper.operators import diagrams as D
from veripaper.operators import duplicates as U
from veripaper.operators import similar_sets as S

from .test_joins import grams, likeness


def made_titles(rng, n):
    words = ["deep", "graphé", "models", "of", "learning", "ßparse", "the", "data", "strêams", "join", "数据", "𝒳𝒴"]
    base = [[rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.choice([1, 3, 5, 30]))] for _ in range(n // 4)]
    near = [[w if rng.random() > 0.1 else rng.choice(words) for w in rng.choice(base)] for _ in range(n - len(base))]
    return [" ".join(t) for t in base + near]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_GRAMS", 1200)
    monkeypatch.setattr(S, "TILE", 7)
    monkeypatch.setattr(S, "WAITING", 5)
    monkeypatch.setattr(S, "CHECKED", 3)
    monkeypatch.setattr(S, "OWN_SIZE", 20)


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_blocks_of_sets(spark, small_blocks, threshold):
    made = made_titles(random.Random(11), 120)
    # Ages are null, equal or in another order than ids; an id comes twice and one is null.
    rows = [(None if i == 5 else 7 if i == 6 else i, t, None if i % 3 else f"2024-01-{i % 28 + 1:02d}") for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "paper_id long, title string, day string")
    sets = U.title_sets(df.select("paper_id", "title", F.col("day").cast("timestamp_ntz").alias("created_at")))
    assert S._Blocks(sets, 1).n > 3
    by_key = {bytes(r["set"]): r for r in sets.collect()}
    value = {k: grams_back(r.grams) for k, r in by_key.items()}
    assert set(map(frozenset, value.values())) == {frozenset(grams(t)) for t in made}
    age = {k: ((r["first"][0] is not None, r["first"][0] or 0), (r["first"][1] is not None, r["first"][1] or 0)) for k, r in by_key.items()}
    alike = {(a, b): likeness(value[a], value[b]) for a in value for b in value if a != b and likeness(value[a], value[b]) > threshold}
    assert len(alike) > 50

    def got(wanted):
        rows = S.similar_sets(sets, sets, threshold, wanted).collect()
        return sorted((bytes(r.l_set), bytes(r.r_set), round(r.score, 9)) for r in rows)

    assert got("both") == sorted((a, b, round(s, 9)) for (a, b), s in alike.items())
    earlier = [(a, b, round(s, 9)) for (a, b), s in alike.items() if age[b] < age[a]]
    assert got("earlier") == sorted(earlier)
    best = {r["set"]: r for r in U._best_set(S.similar_sets(sets, sets, threshold, "best")).collect()}
    assert {bytes(k) for k in best} == {a for a, *_ in earlier}
    for k, r in best.items():
        want = min((-s, age[b], by_key[b]["first"][1]) for a, b, s in earlier if a == bytes(k))
        assert (round(r.similarity, 9), r.similar_paper_id) == (-want[0], want[2])


def grams_back(text):
    return {text[i : i + 3] for i in range(0, len(text), 3)}


def test_two_tables_of_sets(spark, small_blocks):
    rng = random.Random(12)
    made = made_titles(rng, 120)
    tables = [spark.createDataFrame([(i, t, None) for i, t in enumerate(some)], "paper_id long, title string, created_at timestamp_ntz") for some in (made[:50], made[40:])]
    left, right = map(U.title_sets, tables)
    values = [{bytes(r["set"]): grams_back(r.grams) for r in sets.collect()} for sets in (left, right)]
    want = sorted((a, b) for a, x in values[0].items() for b, y in values[1].items() if likeness(x, y) > 0.7)
    assert sorted((bytes(r.l_set), bytes(r.r_set)) for r in S.similar_sets(left, right, 0.7, "earlier").collect()) == want


def test_a_set_is_shuffled_once_for_each_block(spark):
    """A row for each gram with all grams would be quadratic in the length of titles."""
    rng = random.Random(13)
    made = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(made)), "paper_id long, title string")
    plan = U.similar_title_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan


def test_sets_without_grams_and_without_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "paper_id long, title string")
    assert U.duplicate_titles_within(rows).count() == U.similar_title_edges(rows).count() == 0
    some = spark.createDataFrame([(4, "on joins")], "paper_id long, title string")
    assert U.duplicate_by_title(rows, some).count() == U.duplicate_by_title(some, rows).count() == 0
    assert U.duplicate_by_title(some, some).count() == 1


def test_bitmaps_bound_from_below():
    rng = np.random.default_rng(1)
    made = [np.unique(rng.integers(0, 900, rng.integers(1, 400))) for _ in range(60)]
    sets = S._Sets(np.concatenate(made), np.array([len(m) for m in made]))
    for words, bits in sets.bits.items():
        for a in range(60):
            for b in range(60):
                differ = len(np.setxor1d(made[sets.order[a]], made[sets.order[b]]))
                assert sum(int(np.bitwise_count(bits[w][a] ^ bits[w][b])) for w in range(words)) <= differ


def test_hashes_by_all_pairs_and_by_bands(spark, monkeypatch):
    rng = random.Random(21)
    base = [rng.getrandbits(256) for _ in range(6)]
    made = ["%064x" % (rng.choice(base) ^ sum(1 << at for at in rng.sample(range(256), rng.randint(0, 60)))) for _ in range(150)]
    made += [made[0].upper(), "-" * 64, "z" * 64, made[1][:60], None, made[2]]
    df = spark.createDataFrame([(h,) for h in made], "hash string")
    one, two = df.where("hash < '8' or hash is null"), df.where("hash >= '3'")
    monkeypatch.setattr(D, "SMALL_HASH_BLOCK", 16)
    monkeypatch.setattr(D, "HASH_TILE", 64)
    # All pairs are compared in few blocks, nothing is a row for each signature.
    assert "Generate inline" not in D.similar_hash_pairs(df, df, 0.8, 64)._jdf.queryExecution().optimizedPlan().toString()
    for left, right in ((df, df), (one, two)):
        for minimum in (0.8, 0.95):
            found = []
            for row_pairs in (400, -(10**9)):
                monkeypatch.setattr(D, "ROW_PAIRS", row_pairs)
                rows = D.similar_hash_pairs(left, right, minimum, 64).collect()
                found.append(sorted((r["hash"], r.other, round(r.similarity, 9)) for r in rows))
            assert found[0] == found[1] and len(found[0]) > 5
